"""The queries of ``reference`` in SQL, for an independent engine. Written from the queries' meaning, with joins and lists."""

from __future__ import annotations

from asclera import config as cfg
from asclera.operators import prompts as P

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return ", ".join(map(_text, words))


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _has(span: str, words) -> str:
    return f"list_has_any(string_split({span}, ' '), [{_list(words)}])"


_SEEDS = cfg.DX + cfg.RX + cfg.PROC + cfg.FUP
_CATEGORY = (
    f"CASE WHEN {_has('span', cfg.FUP)} THEN 'Fup' WHEN {_has('span', cfg.PROC)} OR regexp_matches(span, '{cfg.PROC_SUFFIX}') THEN 'Proc' "
    f"WHEN {_has('span', cfg.RX)} OR regexp_matches(span, '{cfg.DOSE}') THEN 'Rx' WHEN {_has('span', cfg.DX)} OR regexp_matches(span, '{cfg.DX_SUFFIX}') THEN 'Dx' ELSE 'Other' END"
)


def _spans(source: str, p: str) -> str:
    """CTEs that end in {p}spans (id, pos, span) and {p}found (id, span, category), the first 40, of a table (id, text)."""
    return f"""
{p}tok AS (SELECT id, unnest(range(1, len(t) + 1)) AS i, lower(unnest(t)) AS w FROM (SELECT id, regexp_extract_all(text, '[A-Za-z0-9\\-/]+') AS t FROM {source})),
{p}flag AS (SELECT id, i, w, w IN ({_list(_SEEDS)}) OR regexp_matches(w, '{cfg.DOSE_SEED}') AS f FROM {p}tok),
{p}win AS (SELECT *, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, coalesce(lead(f) OVER o, false) AS f2, coalesce(lead(f, 2) OVER o, false) AS f3 FROM {p}flag WINDOW o AS (PARTITION BY id ORDER BY i)),
{p}gram AS (
  SELECT id, i * 4 + 1 AS o, w AS span FROM {p}win WHERE f
  UNION ALL SELECT id, i * 4 + 2, w || ' ' || w2 FROM {p}win WHERE w2 IS NOT NULL AND (f OR f2)
  UNION ALL SELECT id, i * 4 + 3, w || ' ' || w2 || ' ' || w3 FROM {p}win WHERE w3 IS NOT NULL AND (f OR f2 OR f3)),
{p}first AS (SELECT id, span, min(o) AS o FROM {p}gram WHERE length(span) >= 2 GROUP BY id, span),
{p}spans AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS pos, span FROM {p}first),
{p}found AS (SELECT id, pos, span, {_CATEGORY} AS category FROM {p}spans WHERE pos < 40)"""


def _presence(source: str, p: str) -> str:
    flags = ", ".join(f"coalesce(bool_or(category = '{k}'), false) AS {k.lower()}" for k in cfg.CATEGORIES)
    return _spans(source, p) + f",\n{p}has AS (SELECT s.id, {flags} FROM {source} s LEFT JOIN {p}found f USING (id) GROUP BY s.id)"


_DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"
_PAIRS = """
m AS (SELECT DISTINCT pair_id, chq AS source, summary AS reference FROM meqsum),
r AS (SELECT DISTINCT pred_id, pair_id, run_id, preds AS prediction FROM run_eval),
pairs AS (SELECT pred_id, run_id, source, prediction, reference FROM r JOIN m USING (pair_id))"""
_FLAGGED = f"""{_PAIRS},
src AS (SELECT pred_id AS id, source AS text FROM pairs), prd AS (SELECT pred_id AS id, prediction AS text FROM pairs),
{_presence('src', 's_')}, {_presence('prd', 'p_')}"""
_F1 = "CASE WHEN p + r = 0 THEN 0.0::double ELSE 2 * p * r / (p + r) END"


def _per_category(by: str = "") -> str:
    """CTEs that end in per ([by,] category, tp, fp, fn, p, r)."""
    rows = " UNION ALL ".join(
        f"SELECT {by and by + ', '}'{k}' AS category, s.{k.lower()} AS s, q.{k.lower()} AS q FROM pairs JOIN s_has s ON s.id = pred_id JOIN p_has q ON q.id = pred_id" for k in cfg.CATEGORIES
    )
    cols = by and by + ", "
    return f"""{_FLAGGED}, flags AS ({rows}),
counts AS (SELECT {cols}category, count(*) FILTER (s AND q) AS tp, count(*) FILTER (NOT s AND q) AS fp, count(*) FILTER (s AND NOT q) AS fn FROM flags GROUP BY {cols}category),
per AS (SELECT *, tp / greatest(1, tp + fp)::double AS p, tp / greatest(1, tp + fn)::double AS r FROM counts)"""


def _fkgl(x: str) -> str:
    s = f"len(list_filter(string_split_regex({x}, '[.!?]+'), lambda v: regexp_replace(v, '[{_WS}]+', '', 'g') <> ''))"
    w = f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+')"
    y = f"list_sum(list_transform({w}, lambda v: greatest(1, len(regexp_extract_all(lower(v), '[aeiouy]+')))))"
    return f"CASE WHEN {s} = 0 OR len({w}) = 0 THEN 0.0::double ELSE 0.39::double * (len({w}) / {s}::double) + 11.8::double * ({y} / len({w})::double) - 15.59::double END"


def _section(x: str) -> str:
    labels = "|".join(k.replace("-", r"\-") for k in cfg.SECTION_PRIORS)
    best = {k: max(w for key, w in cfg.SECTION_PRIORS.items() if key in k) for k in cfg.SECTION_PRIORS}
    case = "CASE lower(v) " + " ".join(f"WHEN {_text(k)} THEN {w}::double" for k, w in best.items()) + " END"
    return f"greatest(1.0::double, coalesce(list_max(list_transform(regexp_extract_all({x}, '(?im)^[{_WS}]*({labels})[{_WS}]*[:\\-]', 1), lambda v: {case})), 1.0::double))"


_QUERIES = "queries AS (SELECT DISTINCT pair_id AS query_id, chq AS question FROM meqsum WHERE pair_id % 50 = 0 AND trim(chq) <> '')"
_SPARSE = f"""{_QUERIES},
passages AS (SELECT DISTINCT passage_id, passage_text AS text FROM pubmed_medlineplus_passages WHERE trim(passage_text) <> ''),
q_terms AS (SELECT query_id, term, ln(1 + count(*)) AS qw FROM (SELECT query_id, unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}]+')) AS term FROM queries) GROUP BY ALL),
p_terms AS (SELECT passage_id, term, ln(1 + count(*)) AS pw FROM (SELECT passage_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM passages) GROUP BY ALL),
product AS (SELECT query_id, passage_id, sum(qw * pw) AS s FROM q_terms JOIN p_terms USING (term) GROUP BY ALL),
scored AS (SELECT query_id, passage_id, round(coalesce(s, 0) * {_section('text')}, 6) AS score FROM (SELECT query_id, passage_id, text FROM queries, passages) LEFT JOIN product USING (query_id, passage_id)),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM scored) WHERE rank <= 20)"""


def _vectors(source: str, p: str) -> str:
    """CTEs that end in {p}vec (id, b, x): unit vectors of word buckets of a table (id, text)."""
    return f"""
{p}b AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::bigint % 64 AS b, count(*)::double AS n FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {source}) GROUP BY ALL),
{p}vec AS (SELECT id, b, n / (sqrt(sum(n * n) OVER (PARTITION BY id)) + 1e-9::double) AS x FROM {p}b)"""


_RERANKED = f"""{_SPARSE},
q_src AS (SELECT query_id AS id, question AS text FROM queries), p_src AS (SELECT passage_id AS id, text FROM passages WHERE passage_id IN (SELECT passage_id FROM sparse)),
{_vectors('q_src', 'q_')}, {_vectors('p_src', 'p_')},
dense AS (SELECT query_id, passage_id, coalesce((SELECT sum(a.x * c.x) FROM q_vec a JOIN p_vec c USING (b) WHERE a.id = query_id AND c.id = passage_id), 0) AS d FROM sparse),
scaled AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM sparse WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT query_id, passage_id, round(0.5::double * d + 0.5::double * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END, 6) AS score FROM scaled JOIN dense USING (query_id, passage_id)),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM fused) WHERE rank <= 10)"""

_TRIPLES = f"""
cells AS (SELECT triple_id, {_strip("coalesce(head, '')")} AS head, {_strip("coalesce(relation, '')")} AS relation, {_strip("coalesce(tail, '')")} AS tail FROM umls_triples),
triples AS (SELECT DISTINCT triple_id, head, CASE WHEN relation = '' THEN 'associated_with' ELSE relation END AS relation, tail FROM cells WHERE head <> '' AND tail <> ''),
nodes AS (SELECT node, min(o) AS node_id FROM (SELECT lower(head) AS node, triple_id * 2 AS o FROM triples UNION ALL SELECT lower(tail), triple_id * 2 + 1 FROM triples) GROUP BY node),
node_triples AS (SELECT lower(head) AS node, triple_id FROM triples UNION SELECT lower(tail), triple_id FROM triples)"""


def _grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}), 1) + 1), lambda i: substr(' ' || {x} || ' ', i, 3)))"


_SUBGRAPH = f"""{_TRIPLES}, {_QUERIES}, e_src AS (SELECT query_id AS id, question AS text FROM queries), {_spans('e_src', 'e_')},
entities AS (SELECT DISTINCT id AS query_id, span AS entity FROM e_spans),
ea AS (SELECT DISTINCT entity, {_grams('entity')} AS g FROM entities), nb AS (SELECT node, node_id, {_grams('node')} AS g FROM nodes),
sims AS (SELECT entity, node, node_id, round(len(list_intersect(ea.g, nb.g)) / sqrt(len(ea.g) * len(nb.g)), 6) AS sim FROM ea, nb),
hits AS (SELECT query_id, entity, node, node_id, sim FROM entities JOIN sims USING (entity) WHERE sim >= 0.7),
nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY sim DESC, node_id) AS r FROM sims) WHERE r <= 3),
every AS (SELECT query_id, node, node_id, sim FROM hits UNION ALL SELECT query_id, node, node_id, sim FROM entities JOIN nearest USING (entity) WHERE query_id NOT IN (SELECT query_id FROM hits)),
best AS (SELECT query_id, node, node_id, max(sim) AS sim FROM every GROUP BY ALL),
kept AS (SELECT * FROM triples WHERE relation IN ({_list(cfg.SALIENT_RELATIONS)})),
found AS (SELECT query_id, head, relation, tail, -sim AS s, node_id, triple_id FROM best JOIN node_triples USING (node) JOIN kept USING (triple_id)),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, head, relation, tail ORDER BY s, node_id, triple_id) AS k FROM found) WHERE k = 1),
sub AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s, node_id, triple_id) AS ord, head, relation, tail FROM firsts) WHERE ord <= 15)"""

_QUESTIONS = "questions AS (SELECT DISTINCT pair_id AS id, chq AS source, summary AS target FROM meqsum WHERE chq IS NOT NULL AND summary IS NOT NULL)"
_SPLIT = f"""{_QUESTIONS},
hashed AS (SELECT *, ('0x' || substr(md5(id::varchar || ':42'), 1, 8))::bigint AS h FROM questions),
split AS (SELECT *, row_number() OVER (ORDER BY h, id) <= ceil(0.2::double * count(*) OVER ()) AS is_test FROM hashed)"""


def _fill(template: str, **values: str) -> str:
    out = _text(template)
    for k, v in values.items():
        out = out.replace("{" + k + "}", f"' || {v} || '")
    return out


def _bleu(by: str) -> str:
    toks = "list_filter(string_split_regex(coalesce({}, ''), '[ \\t\\n\\r\\x0c]+'), lambda v: v <> '')"
    grams = " UNION ALL ".join(
        f"SELECT {by}, pred_id, {n} AS n, array_to_string(t[i:i + {n - 1}], ' ') AS g, {side} AS side FROM (SELECT {by}, pred_id, {c} AS t, unnest(range(1, len({c}) - {n - 2})) AS i FROM t)"
        for n in range(1, 5)
        for side, c in ((0, "p"), (1, "r"))
    )
    sizes = ", ".join(f"sum(greatest(len(p) - {n - 1}, 0)) AS t{n}" for n in range(1, 5))
    hits = ", ".join(f"coalesce(sum(least(a, b)) FILTER (n = {n}), 0) AS m{n}" for n in range(1, 5))
    logs = " + ".join(f"ln(m{n} / t{n}::double)" for n in range(1, 5))
    return f"""t AS (SELECT {by}, pred_id, {toks.format('prediction')} AS p, {toks.format('reference')} AS r FROM pairs),
grams AS ({grams}),
sides AS (SELECT {by}, pred_id, n, g, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM grams GROUP BY ALL),
hits AS (SELECT {by}, {hits} FROM sides GROUP BY {by}),
sizes AS (SELECT {by}, sum(len(p)) AS c, sum(len(r)) AS r, {sizes} FROM t GROUP BY {by}),
bleus AS (SELECT {by}, CASE WHEN least(m1, m2, m3, m4) = 0 THEN 0.0::double ELSE CASE WHEN c >= r THEN 1.0 ELSE exp(1 - r / c::double) END * exp(({logs}) / 4) END AS bleu FROM sizes JOIN hits USING ({by}))"""


_ROUGE = """
toks AS (SELECT pred_id, run_id, regexp_extract_all(lower(coalesce(prediction, '')), '[a-z0-9]+') AS p, regexp_extract_all(lower(coalesce(reference, '')), '[a-z0-9]+') AS r FROM pairs),
lcs AS (
  SELECT pred_id, p, r, 0 AS j, list_transform(range(0, len(r)), lambda x: 0::bigint) AS row FROM toks
  UNION ALL
  SELECT pred_id, p, r, j + 1, list_transform(range(1, len(r) + 1), lambda i: list_max(c[1:i])) FROM (
    SELECT pred_id, p, r, j, list_transform(range(1, len(r) + 1), lambda i: CASE WHEN r[i] = p[j + 1] THEN coalesce(row[i - 1], 0) + 1 ELSE row[i] END) AS c FROM lcs WHERE j < len(p) AND len(r) > 0)),
rouges AS (SELECT pred_id, CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0.0::double ELSE 2 * row[len(r)] / (len(p) + len(r))::double END AS rouge_l FROM lcs WHERE j = len(p) OR len(r) = 0 AND j = 0)"""



def _measured(by: str) -> str:
    """CTEs after per ([by,] ...) that end in measured (by, n_samples, fkgl, rouge_l, macro_f1, chr_pct, risk, f1_*, bleu)."""
    f1_of = ", ".join(f"round(max(f1) FILTER (category = '{k}'), 4) AS f1_{k.lower()}" for k in cfg.CATEGORIES)
    return f"""{_ROUGE}, {_bleu(by)},
f1s AS (SELECT {by}, category, {_F1} AS f1 FROM per),
macros AS (SELECT {by}, sum(f1) / 4 AS m, {f1_of} FROM f1s GROUP BY {by}),
simple AS (SELECT {by}, count(*) AS n_samples, round(avg({_fkgl("coalesce(prediction, '')")}), 1) AS fkgl, round(avg(rouge_l), 4) AS rouge_l FROM pairs JOIN rouges USING (pred_id) GROUP BY {by}),
measured AS (SELECT {by}, n_samples, fkgl, rouge_l, round(m, 4) AS macro_f1, round((1 - m) * 100, 2) AS chr_pct,
  CASE WHEN (1 - m) * 100 >= 40 THEN 'High' WHEN (1 - m) * 100 >= 30 THEN 'Moderate' ELSE 'Low' END AS risk, f1_dx, f1_rx, f1_proc, f1_fup, round(bleu, 4) AS bleu
  FROM simple JOIN macros USING ({by}) JOIN bleus USING ({by}))"""


# Greedy selection: the state is what is chosen (ranks, in order), what is left, and the tokens used.
_MMR = f"""{_RERANKED},
units AS (SELECT id, b, x / (sqrt(sum(x * x) OVER (PARTITION BY id)) + 1e-9::double) AS x FROM p_vec),
pairwise AS (SELECT a.query_id, a.rank AS i, c.rank AS j, coalesce((SELECT sum(u.x * v.x) FROM units u JOIN units v USING (b) WHERE u.id = a.passage_id AND v.id = c.passage_id), 0) AS sim
  FROM reranked a JOIN reranked c USING (query_id)),
rows_ AS (SELECT query_id, i, list(sim ORDER BY j) AS sims FROM pairwise GROUP BY query_id, i),
matrix AS (SELECT query_id, list(sims ORDER BY i) AS sims FROM rows_ GROUP BY query_id),
lists AS (SELECT query_id, list(passage_id ORDER BY rank) AS ids,
  list(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE score END ORDER BY rank) AS rel,
  list(len(list_filter(string_split_regex(text, '[{_WS}]+'), lambda v: v <> '')) ORDER BY rank) AS tok
  FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM reranked WINDOW w AS (PARTITION BY query_id)) JOIN passages USING (passage_id) GROUP BY query_id),
given AS (SELECT * FROM lists JOIN matrix USING (query_id)),
walk AS (
  SELECT query_id, ids, rel, tok, sims, [1::bigint] AS sel, range(2, len(ids) + 1) AS rem, tok[1] AS used FROM given
  UNION ALL
  SELECT query_id, ids, rel, tok, sims, list_append(sel, pick), list_filter(left_, lambda i: i <> pick), used + tok[pick] FROM (
    SELECT *, CASE WHEN over THEN list_min(fits) ELSE best END AS pick, CASE WHEN over THEN list_filter(rem, lambda i: i <> best) ELSE rem END AS left_ FROM (
      SELECT *, used + tok[best] > 512 AS over, list_filter(rem, lambda i: i <> best AND used + tok[i] <= 512) AS fits FROM (
        SELECT *, -list_max(list_transform(rem, lambda i: {{'s': round(0.7::double * rel[i] - (1 - 0.7::double) * list_max(list_transform(sel, lambda j: sims[i][j])), 9), 'n': -i}})).n AS best
        FROM walk WHERE len(rem) > 0 AND used < 512)))
  WHERE pick IS NOT NULL),
longest AS (SELECT query_id, ids, sel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY len(sel) DESC) AS k FROM walk) WHERE k = 1),
selected AS (SELECT query_id, unnest(range(1, len(sel) + 1)) AS ord, ids[unnest(sel)] AS passage_id FROM longest)"""


_BLOCKS = f"""{_MMR}, {_SUBGRAPH.replace(_QUERIES + ', ', '')},
evidence AS (SELECT query_id, string_agg('[E' || ord || '] ' || replace({_strip('text')}, chr(10), ' '), chr(10) ORDER BY ord) AS evidence FROM selected JOIN passages USING (passage_id) WHERE ord <= 5 GROUP BY query_id),
knowledge AS (SELECT query_id, string_agg('• (' || head || ') --[' || relation || ']--> (' || tail || ')', chr(10) ORDER BY ord) AS knowledge FROM sub GROUP BY query_id),
known AS (SELECT query_id, question, coalesce(evidence, {_text(P.NO_EVIDENCE)}) AS evidence, CASE WHEN query_id NOT IN (SELECT query_id FROM entities) THEN {_text(P.NO_CONCEPTS)} ELSE coalesce(knowledge, {_text(P.NO_KNOWLEDGE)}) END AS knowledge
  FROM queries LEFT JOIN evidence USING (query_id) LEFT JOIN knowledge USING (query_id))"""
_PREFIX = f"""shots AS (SELECT * FROM split WHERE NOT is_test ORDER BY h, id LIMIT 3),
prefix AS (SELECT {_text(P.FEW_SHOT)} || chr(10) || string_agg('Input: ' || source || chr(10) || 'Reformulated: ' || target || chr(10), chr(10) ORDER BY h, id) AS p FROM shots)"""
_BUCKETS = "list_transform(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'), lambda w: ('0x' || substr(md5(w), 1, 8))::bigint % 64)"
_RUN = f"""{_SPLIT},
pairs AS (SELECT id * 2 + k AS pred_id, 0 AS run_id, setting, source, regexp_extract(source, '^[^.?!]*') AS prediction, target AS reference FROM split, (VALUES ('zero_shot', 0), ('few_shot', 1)) v(setting, k) WHERE is_test)"""


def oracle_sql() -> dict[str, str]:
    low = {k: k.lower() for k in cfg.CATEGORIES}
    bucket = ", ".join(f"coalesce(string_agg(span, '; ' ORDER BY pos) FILTER (category = '{k}'), '') AS {v}" for k, v in low.items())
    edge = r"[^\p{L}\p{N}_]"
    flags = {n: f"regexp_matches(coalesce(text, ''), '(?i)(^|{edge})({p})($|{edge})') AS {n}" for n, p in cfg.QUALIFIERS.items()}
    same = {k: f"(s.{v} = q.{v})::integer::double" for k, v in low.items()}
    score = "(" + " + ".join(same.values()) + ") / 4"
    risk = "CASE WHEN {0} >= 40 THEN 'High' WHEN {0} >= 30 THEN 'Moderate' ELSE 'Low' END"
    aliases = " ".join(f"WHEN category IN ({_list([c for c, v in cfg.VOCABULARY_OF.items() if v == voc])}) AND lower(span) = {_text(s)} THEN {_text(to)}" for voc, names in cfg.ALIASES.items() for s, to in names.items())
    named = [(s, c) for v in cfg.ALIASES.values() for s in v for c in cfg.CATEGORIES]
    header = "Faithfulness F1 report: all runs on meqsum"
    lines = [_text(header), _text("-" * len(header)), "printf('  F1          : %.4f', m)", f"printf('  CHR%%        : %.2f%%  [', (1 - m) * 100) || {risk.format('((1 - m) * 100)')} || ']'"]
    lines += [f"printf('  F1 ({k:4s})  : %.4f', f1_{v})" for k, v in low.items()]
    f1_of = ", ".join(f"max(f1) FILTER (category = '{k}') AS f1_{v}" for k, v in low.items())
    return {
        "pair_scan": f"WITH {_QUESTIONS} SELECT * FROM questions",
        "corpus_scan": f"SELECT DISTINCT passage_id, {_strip('passage_text')} AS text FROM pubmed_medlineplus_passages WHERE {_strip('passage_text')} <> ''",
        "clinical_tokens": "SELECT doc_id, unnest(range(0, len(t))) AS pos, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9\\-/]+') AS t FROM documents)",
        "candidate_spans": f"WITH {_DOCS}, {_spans('docs', '')} SELECT id AS doc_id, pos, span FROM spans",
        "span_categories": f"WITH {_DOCS}, {_spans('docs', '')} SELECT span, count(*) AS n_docs, {_CATEGORY} AS category FROM spans GROUP BY span",
        "concept_buckets": f"WITH {_DOCS}, {_spans('docs', '')} SELECT d.id AS doc_id, {bucket} FROM docs d LEFT JOIN found USING (id) GROUP BY d.id",
        "category_presence": f"WITH {_DOCS}, {_presence('docs', '')} SELECT id AS doc_id, dx, rx, proc, fup FROM has",
        "qualifier_flags": f"SELECT doc_id, {', '.join(flags.values())} FROM documents",
        "faithfulness_f1": f"WITH {_per_category()}, done AS (SELECT category, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, {_F1} AS f1 FROM per) "
        "SELECT category, tp, fp, fn, precision, recall, round(f1, 6) AS f1 FROM done UNION ALL SELECT 'macro', NULL, NULL, NULL, NULL, NULL, round(coalesce(sum(f1) / 4, 0), 6) FROM done",
        "faithfulness_single": f"WITH {_FLAGGED} SELECT pred_id, {', '.join(f'{x} AS {low[k]}' for k, x in same.items())}, {score} AS score, round((1 - {score}) * 100, 6) AS chr_pct, "
        f"{risk.format(f'((1 - {score}) * 100)')} AS risk FROM pairs JOIN s_has s ON s.id = pred_id JOIN p_has q ON q.id = pred_id",
        "faithfulness_report": f"WITH {_per_category()}, f AS (SELECT category, {_F1} AS f1 FROM per), g AS (SELECT sum(f1) / 4 AS m, {f1_of} FROM f) "
        f"SELECT unnest(range(0, {len(lines)})) AS line_no, unnest([{', '.join(lines)}]) AS line FROM g",
        "faithfulness_by_run": f"WITH {_per_category('run_id')}, f AS (SELECT run_id, {_F1} AS f1 FROM per), g AS (SELECT run_id, sum(f1) / 4 AS m FROM f GROUP BY run_id) "
        f"SELECT run_id, round(m, 6) AS macro_f1, round((1 - m) * 100, 4) AS chr_pct, {risk.format('((1 - m) * 100)')} AS risk FROM g",
        "section_weight": f"SELECT DISTINCT passage_id, {_section('passage_text')} AS section_weight FROM pubmed_medlineplus_passages",
        "token_counts": f"SELECT doc_id, len(list_filter(string_split_regex(text, '[{_WS}]+'), lambda v: v <> '')) AS n_tokens FROM documents",
        "fkgl_by_lang": f"SELECT lower(coalesce(lang, 'none')) AS lang, count(*) AS n_docs, round(avg({_fkgl('text')}), 6) AS fkgl FROM documents GROUP BY 1",
        "fkgl_documents": f"SELECT doc_id, round({_fkgl('text')}, 6) AS fkgl FROM documents",
        "postings_index": "WITH p AS (SELECT DISTINCT passage_id, passage_text AS t FROM pubmed_medlineplus_passages), w AS (SELECT passage_id, unnest(regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+')) AS term FROM p), "
        "c AS (SELECT passage_id, term, ln(1 + count(*)) AS weight FROM w GROUP BY ALL) SELECT term, count(*) AS n_passages, round(sum(weight), 6) AS weight FROM c GROUP BY term",
        "sparse_topk": f"WITH {_SPARSE} SELECT query_id, passage_id, score, rank FROM sparse",
        "dense_topk": "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) "
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10",
        "rerank_hybrid": f"WITH {_RERANKED} SELECT query_id, passage_id, score, rank FROM reranked",
        "evidence_block": f"WITH {_RERANKED} SELECT query_id, string_agg('[E' || rank || '] ' || replace({_strip('text')}, chr(10), ' '), chr(10) ORDER BY rank) AS evidence FROM reranked JOIN passages USING (passage_id) WHERE rank <= 5 GROUP BY query_id",
        "kg_triples": f"WITH {_TRIPLES} SELECT triple_id, head, relation, tail FROM triples",
        "kg_nodes": f"WITH {_TRIPLES} SELECT node, node_id, count(*) AS n_triples FROM nodes JOIN node_triples USING (node) GROUP BY node, node_id",
        "kg_subgraph": f"WITH {_SUBGRAPH} SELECT query_id, ord, head, relation, tail FROM sub",
        "kg_context": f"WITH {_SUBGRAPH} SELECT query_id, string_agg('• (' || head || ') --[' || relation || ']--> (' || tail || ')', chr(10) ORDER BY ord) AS knowledge FROM sub GROUP BY query_id",
        "normalise_spans": f"WITH {_DOCS}, {_spans('docs', '')}, a AS (SELECT DISTINCT span, {_CATEGORY} AS category FROM spans UNION SELECT * FROM (VALUES {', '.join(f'({_text(s)}, {_text(c)})' for s, c in named)})) "
        f"SELECT span, category, CASE {aliases} ELSE span END AS preferred FROM a",
        "base_prompt": f"WITH {_QUESTIONS} SELECT id, {_text(P.SYSTEM)} AS system, {_fill(P.BASE, question='source')} AS user FROM questions",
        "training_prompt": f"WITH {_QUESTIONS} SELECT id, {_fill(P.TRAINING.replace('{evidence}', '(no evidence)').replace('{knowledge}', '(no knowledge context)'), question='source')} AS user, target FROM questions",
        "mmr_select": f"WITH RECURSIVE {_MMR} SELECT query_id, ord, passage_id FROM selected",
        "grounded_prompt": f"WITH RECURSIVE {_BLOCKS} SELECT query_id, {_text(P.SYSTEM)} AS system, {_fill(P.GROUNDED, evidence='evidence', knowledge='knowledge', question='question')} AS user FROM known",
        "rag_prompt": f"WITH RECURSIVE {_BLOCKS} SELECT query_id, {_text(P.SYSTEM)} AS system, {_fill(P.GROUNDED.replace('{knowledge}', P.KNOWLEDGE_OFF), evidence='evidence', question='question')} AS user FROM known",
        "switched_off_prompt": f"WITH {_QUERIES} SELECT query_id, {_text(P.SYSTEM)} AS system, {_fill(P.GROUNDED.replace('{evidence}', P.EVIDENCE_OFF).replace('{knowledge}', P.KNOWLEDGE_OFF), question='question')} AS user FROM queries",
        "config_prompts": f"WITH RECURSIVE {_BLOCKS.replace('pair_id % 50 = 0', 'pair_id IS NOT NULL')}, {_SPLIT}, {_PREFIX}, prompts AS (SELECT 'none' AS retrieval, query_id, {_fill(P.BASE, question='question')} AS user FROM queries "
        f"UNION ALL SELECT 'rag', query_id, {_fill(P.GROUNDED.replace('{knowledge}', P.KNOWLEDGE_OFF), evidence='evidence', question='question')} FROM known UNION ALL SELECT 'ekg_rag', query_id, {_fill(P.GROUNDED, evidence='evidence', knowledge='knowledge', question='question')} FROM known) "
        "SELECT 'zero_shot' AS setting, retrieval, query_id, user FROM prompts UNION ALL SELECT 'few_shot', retrieval, query_id, p || chr(10) || chr(10) || user FROM prompts, prefix",
        "reformulations": f"WITH {_QUERIES} SELECT query_id, regexp_extract(question, '^[^.?!]*') AS output FROM queries",
        "first_candidates": f"WITH {_SPARSE} SELECT query_id, rank AS ord, passage_id FROM sparse WHERE rank <= 5",
        "term_pooling": "SELECT id, printf('t%03d', i) AS term, round(w, 6) AS weight FROM (SELECT vec_id // 10 AS id, i, max(ln(1 + greatest(x::double, 0))) AS w FROM "
        "(SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY ALL) WHERE w > 0",
        "evaluation_run": f"WITH RECURSIVE {_per_category('setting').replace(_PAIRS, _RUN)}, {_measured('setting')} SELECT setting, 'none' AS retrieval, n_samples, f1_dx AS dx, f1_rx AS rx, f1_proc AS proc, f1_fup AS fup, macro_f1, chr_pct, risk, fkgl, rouge_l, bleu FROM measured",
        "bert_score": f"WITH {_PAIRS}, b AS (SELECT pred_id, {_BUCKETS.format('prediction')} AS p, {_BUCKETS.format('reference')} AS r FROM pairs), "
        "s AS (SELECT pred_id, CASE WHEN len(p) * len(r) = 0 THEN 0.0::double ELSE len(list_filter(p, lambda x: list_contains(r, x))) / len(p)::double END AS bp, CASE WHEN len(p) * len(r) = 0 THEN 0.0::double ELSE len(list_filter(r, lambda x: list_contains(p, x))) / len(r)::double END AS br FROM b) "
        "SELECT pred_id, round(bp, 6) AS bert_p, round(br, 6) AS bert_r, round(CASE WHEN bp + br = 0 THEN 0 ELSE 2 * bp * br / (bp + br) END, 6) AS bert_f1 FROM s",
        "rouge_l": f"WITH RECURSIVE {_PAIRS}, {_ROUGE} SELECT pred_id, round(rouge_l, 6) AS rouge_l FROM rouges",
        "eval_metrics": f"WITH RECURSIVE {_per_category('one').replace('pairs AS (SELECT pred_id, run_id', 'pairs AS (SELECT 1 AS one, pred_id, run_id')}, {_measured('one')} SELECT n_samples, fkgl, rouge_l, macro_f1, chr_pct, risk, f1_dx AS \"Dx\", f1_rx AS \"Rx\", f1_proc AS \"Proc\", f1_fup AS \"Fup\", bleu FROM measured",
        "experiment_grid": f"WITH RECURSIVE {_per_category('run_id')}, {_measured('run_id')} SELECT run_id, model_name, setting, retrieval, n_samples, f1_dx AS dx, f1_rx AS rx, f1_proc AS proc, f1_fup AS fup, macro_f1, chr_pct, risk, fkgl, rouge_l, bleu FROM eval_runs LEFT JOIN measured USING (run_id)",
        "train_test_split": f"WITH {_SPLIT} SELECT id, is_test FROM split",
        "few_shot_prompt": f"WITH {_SPLIT}, {_PREFIX} SELECT id, p || chr(10) || chr(10) || {_fill(P.BASE, question='source')} AS user FROM split, prefix WHERE is_test",
        "bleu4": f"WITH {_PAIRS}, {_bleu('run_id')} SELECT run_id, round(bleu, 6) AS bleu FROM bleus",
        "batch_inference": f"WITH {_QUESTIONS} SELECT id, regexp_extract(source, '^[^.?!]*') AS output FROM questions",
        "event_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
        "top_runs": f"WITH {_per_category('run_id')}, f AS (SELECT run_id, {_F1} AS f1 FROM per), g AS (SELECT run_id, round(sum(f1) / 4, 6) AS macro_f1 FROM f GROUP BY run_id) "
        "SELECT retrieval, rank, run_id, model_name, macro_f1 FROM (SELECT *, row_number() OVER (PARTITION BY retrieval ORDER BY macro_f1 DESC, run_id) AS rank FROM g JOIN eval_runs USING (run_id)) WHERE rank <= 3",
    }
