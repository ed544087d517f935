"""SQL of the text queries that SQL can express: brute force over all pairs."""

from __future__ import annotations


def _overlap(source: str) -> str:
    """CTEs that end in near (a, b): pairs of ids of a table (id, text) whose multiset overlap of words is at least 0.8."""
    return f"""
words AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {source}),
features AS (SELECT id, w, row_number() OVER (PARTITION BY id, w) AS k FROM words),
sizes AS (SELECT id, count(*) AS n FROM words GROUP BY id),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM features x JOIN features y USING (w, k) WHERE x.id < y.id GROUP BY ALL),
near AS (SELECT a, b FROM common JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE i / greatest(p.n, q.n)::double >= 0.8 - 1e-9)"""


def _across(table: str, id_col: str, question: str, other: str) -> str:
    return f"""SELECT '{table}' AS table_name, a AS record_id_a, b AS record_id_b FROM (
WITH records AS (SELECT DISTINCT {id_col} AS id, {question} || chr(10) || coalesce({other}, '') AS text, lower(trim(coalesce(split_name, ''))) = 'train' AS train
  FROM {table} WHERE regexp_matches({question}, '[\\p{{L}}\\p{{N}}]')), {_overlap('records')}
SELECT a, b FROM near JOIN records x ON x.id = a JOIN records y ON y.id = b WHERE x.train <> y.train)"""


def oracle_sql() -> dict[str, str]:
    found = _across("meqsum", "pair_id", "chq", "summary") + " UNION ALL " + _across("mqp", "mqp_id", "question", "target")
    passages = "passages AS (SELECT DISTINCT passage_id AS id, passage_text AS text FROM pubmed_medlineplus_passages WHERE passage_text IS NOT NULL)"
    return {
        "p1_found": f"WITH {passages}, {_overlap('passages')} SELECT a AS passage_id_a, b AS passage_id_b FROM near",
        # classes: equal multisets of words, named by their least id; groups: what the least ids reach over links
        "p1_groups": f"WITH RECURSIVE {passages}, {_overlap('passages')}, bags AS (SELECT id, list(w ORDER BY w) AS bag FROM words GROUP BY id), "
        "classes AS (SELECT id, min(id) OVER (PARTITION BY bag) AS cls, count(*) OVER (PARTITION BY bag) AS copies FROM bags), "
        "links AS (SELECT DISTINCT x.cls AS a, y.cls AS b FROM near JOIN classes x ON x.id = a JOIN classes y ON y.id = b WHERE x.cls <> y.cls), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links), "
        "reach AS (SELECT DISTINCT cls, cls AS seen FROM classes UNION SELECT cls, b FROM reach JOIN edges ON a = seen), groups AS (SELECT cls, min(seen) AS g FROM reach GROUP BY cls), "
        "degree AS (SELECT a AS cls, count(*) AS links FROM edges GROUP BY a) "
        "SELECT id AS passage_id, g AS group_id, copies, coalesce(links, 0) AS links FROM classes JOIN groups USING (cls) LEFT JOIN degree USING (cls)",
        "p4_found": found,
        "p4_report": f"WITH found AS ({found}), names AS (SELECT DISTINCT 'meqsum' AS table_name, pair_id AS eval_id, lower(trim(split_name)) AS split_name FROM meqsum UNION SELECT DISTINCT 'mqp', mqp_id, lower(trim(split_name)) FROM mqp), "
        "sides AS (SELECT table_name, record_id_a AS eval_id, record_id_b FROM found UNION ALL SELECT table_name, record_id_b, record_id_a FROM found) "
        "SELECT table_name, split_name, count(*) AS n_pairs, count(DISTINCT eval_id) AS n_records FROM sides JOIN names USING (table_name, eval_id) WHERE split_name IS DISTINCT FROM 'train' GROUP BY table_name, split_name",
    }
