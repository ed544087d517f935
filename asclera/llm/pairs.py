"""Defects of prompt and response pairs: empty, refusal, copy, other_language, truncated.

Language: the posteriors of prompt and response under naive Bayes over character n-grams are compared. Truncation: how
likely a text is to end after its last words, under word n-grams of complete answers in which rare words (names) are one
class, and, if the last word is rare, how likely a word is to end after its last letters. Copy: the best local alignment of
the response to the whole prompt; a prompt of fewer than four words must be the whole answer. Empty: fixed placeholders. Refusal: fixed patterns name the first
refusals, naive Bayes over words and pairs of words learns from all responses how these differ from the others, and what the
response shares with its prompt does not count; so a question about something one cannot do is none, and a refusal that no
pattern has can be one.

A response with an end mark is never truncated, as it ends where a sentence does. Defined results: a response has one defect at most, the first of the order above; a null or blank prompt is no defect and
leaves out copy and other_language; repeated rows give one row; responses of any length are read whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asclera.llm.languages import Languages
from asclera.llm.leakage import align
from asclera.runtime import materialize

EMPTY, TRUNCATED, REFUSAL, COPY, OTHER_LANGUAGE = "empty", "truncated", "refusal", "copy", "other_language"

# What stands in for an answer that isn't there, without marks and in lower case.
PLACEHOLDERS = {"", "na", "n a", "none", "null", "nil", "nan", "no answer", "no response", "no summary", "not available", "not applicable", "unanswered", "empty", "blank", "missing", "undefined", "unknown", "tbd", "todo", "placeholder", "no data", "no output", "no prediction", "no reply", "xxx", "test"}
# How answers decline, in languages that occur.
_CANNOT = r"(?:can(?:no|')t|can not|could not|couldn't|won't(?: be able to)?|will not(?: be able to)?|(?:am|are|'m|'re)(?: \w+)? (?:not|un)(?: |-)?(?:able|allowed|permitted|willing|going|in a position|qualified|comfortable)(?: to)?|unable to|must decline to|have to decline to|must refuse to|decline to|refuse to|would rather not|prefer not to)"
_ACT = r"(?:help|assist|answer|respond|reply|comment|discuss|process|provide|give|offer|rewrite|rephrase|reformulate|shorten|summari[sz]e|fulfil+|comply|complete|continue|do (?:this|that)|share|produce|generate|engage|support|advise|speak|talk|accept|handle|address)"
REFUSALS = re.compile(
    "|".join(
        [
            rf"\b(?:i|we)(?:'m|'re)?(?: \w+){{0,2}}? {_CANNOT}(?: \w+){{0,2}}? {_ACT}\b",
            rf"\b(?:i'm|i am|we are|we're)(?: \w+)? (?:not able|unable|not allowed|not permitted) to {_ACT}\b",
            r"\b(?:i|we) (?:must|have to|will have to|need to) (?:decline|refuse)\b",
            r"\b(?:beyond|outside(?: of)?|more than) what i(?: am|'m)? (?:allowed|able|permitted|can)\b",
            r"\b(?:my|our|the) (?:guidelines|policy|policies|rules|instructions|safety \w+|programming)(?: \w+)? (?:prevent|prohibit|forbid|do not|don't|does not|doesn't|keep)\b",
            r"\bagainst (?:my |our |the |its )?(?:policy|policies|guidelines|rules)\b",
            r"\b(?:not|in)(?: be)? ?appropriate for me to\b",
            r"\bno (?:answer|response|reply|summary|reformulation|information|advice|comment|help) (?:can|could|may|will|is able to) be (?:\w+ ){0,2}?(?:given|provided|offered|made|shared|produced|generated)\b",
            r"\b(?:question|request|message|query|this|it) (?:cannot|can't|can not|must not|will not|won't) be (?:answered|processed|fulfilled|completed|handled|rewritten|summari[sz]ed|shortened|discussed)\b",
            r"\bfor safety reasons\b.*\b(?:contact|consult|ask|see|talk to)\b",
            r"\bas an? (?:large )?(?:ai|artificial intelligence|language model)\b.*\b(?:not|can't|cannot|unable)\b",
            r"\b(?:i|we)(?: really)? (?:do not|don't|would not|wouldn't) (?:feel|think|believe)\b(?: \w+){0,4} (?:comfortable|able|right|appropriate|proper|qualified|safe|should|can)\b",
            r"\bje (?:ne|n')(?: \w+){0,2} ?(?:peux|suis|puis)(?: \w+){0,3} (?:pas|autorisée?)\b.*\b(?:aider|répondre|conseil|demande|question)",
            r"\b(?:ich|wir) (?:kann|können|darf|dürfen|muss|möchte)\b.*\b(?:nicht|ablehnen|keine)\b.*\b(?:helfen|beantworten|antworten|auskunft|anfrage|diese frage)",
            r"\b(?:no puedo|no podemos|no me es posible|no estoy autorizad[oa]|debo rechazar)\b.*\b(?:ayudar|responder|contestar|comentar|pregunta|solicitud)",
        ]
    )
)
_END = re.compile(r"[.?!。？！;]+[\"'”’»)\]]*$")
_SENTENCE = re.compile(r"(?<=[.?!])[\"'”’)]*\s+(?=\S)")
_TOKEN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*|,|;|:")
_BROKEN_OFF = re.compile(r"(?:…|\w\.\.\.|\w-|[‐–—])[\"'”’]*$")


def visible(text: str | None) -> str:
    """The text without invisible characters and outer white space."""
    if not text:
        return ""
    if not text.isascii():
        text = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t\r")
    return text.strip()


def is_empty(shown: str) -> bool:
    return re.sub(r"[\W_]+", " ", shown.lower()).strip() in PLACEHOLDERS


def looks_like_refusal(shown: str) -> bool:
    return bool(REFUSALS.search(re.sub(r"\s+", " ", shown.lower().replace("’", "'"))))


_REFUSAL_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[?!.]")


def refusal_words(shown: str) -> list[str]:
    return _REFUSAL_WORD.findall(shown.lower().replace("’", "'"))


def refusal_features(words: list[str]) -> set[str]:
    """Words and end marks, pairs of them, and those at the edges."""
    w = ["^", *words, "$"]
    return {*words, *map(" ".join, zip(w, w[1:], strict=False))}


class Refusals:
    """How much more usual a feature is in responses that look like refusals than in others: the log ratio of its rates, each
    drawn to the common one by ``back`` texts. counts: feature -> (texts that look like refusals, others).

    A response that looks like a refusal is one if the mean over its features is ``least``; any other is if it is ``alone``
    over ``enough`` features, of which one word has ``alone`` by itself. Without ``known`` examples to learn from, looks decide."""

    def __init__(self, counts: dict[str, tuple[int, int]], refused: int, others: int, back: float = 8.0, least: float = 2.0, alone: float = 3.5, enough: int = 5, known: int = 5):
        self.least, self.alone, self.enough, self.learned = least, alone, enough, refused >= known and others >= known
        self.weight = {}
        for f, (a, b) in counts.items():
            if a + b > 1:
                p = (a + b) / (refused + others)
                self.weight[f] = math.log((a + back * p) / (refused + back)) - math.log((b + back * p) / (others + back))
        self.telling = {f for f, x in self.weight.items() if x >= alone and " " not in f}

    def __call__(self, shown: str, prompt: str = "") -> bool:
        looks = looks_like_refusal(shown)
        if not self.learned:
            return looks
        words = refusal_words(shown)
        if not looks and self.telling.isdisjoint(words):
            return False
        own = refusal_features(words) - (refusal_features(refusal_words(prompt)) if prompt else set())
        w = [x for f in own if (x := self.weight.get(f)) is not None]
        mean = sum(w) / len(w) if w else 0.0
        return mean >= self.least if looks else len(w) >= self.enough and mean >= self.alone


def _refusal_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for t in set(b.column(0).to_pylist()):
            if not is_empty(s := visible(t)):
                side = not looks_like_refusal(s)
                for f in (*refusal_features(refusal_words(s)), ""):
                    counts[f][side] += 1
        yield _rows([(f, *n) for f, n in counts.items()], feature=pa.string(), refused=pa.int64(), others=pa.int64())


def fit_refusals(pairs: DataFrame, features: int = 300_000) -> Refusals:
    """Counted over all responses, repeated ones once a task; kept are the features of most texts (the bound) that occur in more than one."""
    given = pairs.where("response is not null").select("response")
    total = given.mapInArrow(_refusal_counts, "feature string, refused long, others long").groupBy("feature").agg(F.sum("refused").alias("refused"), F.sum("others").alias("others"))
    kept = {r.feature: (r.refused, r.others) for r in total.where("refused + others > 1").orderBy(F.desc(F.col("refused") + F.col("others")), "feature").limit(features).collect()}
    return Refusals(kept, *kept.pop("", (0, 0)))


def sentences_of(text: str) -> tuple[list[list[str]], bool]:
    """The words of each sentence, and whether the text has an end mark."""
    return [_TOKEN.findall(s.lower()) for s in _SENTENCE.split(text)], bool(_END.search(text))


def words_in(sentences: list[list[str]], marked: bool) -> Iterator[tuple[str, bool]]:
    """Each word, and whether it is the last one of a text without an end mark."""
    for k, s in enumerate(sentences):
        for i, w in enumerate(s):
            yield w, not marked and k + 1 == len(sentences) and i + 1 == len(s)


class Endings:
    """How likely texts and words end where they do, learned from answers most of which are complete.

    answers: (group, text); ``counted``: the texts that are asked for are among them. A word is known if it is in answers of at least ``known_share`` of the groups, ``known_least`` at
    least. Others are one class, as names are. Where texts can end, ``ends`` of
    those that come there do; where they cannot, ``breaks`` do, as they break off. A word is whole if it is seen before another word, before an end mark, in one of
    ``others``, or at several unmarked ends without being the beginning of another.
    """

    def __init__(self, answers: list[tuple[int, str]], others: list[str] | None = None, known_share: float = 0.004, known_least: int = 3, ends: float = 0.5, breaks: float = 0.04, longest: int = 7):
        split = [(g, *sentences_of(t)) for g, t in answers]
        inside, finals = defaultdict(set), defaultdict(set)
        for g, sentences, marked in split:
            for w, last in words_in(sentences, marked):
                (finals if last else inside)[w].add(g)
        prompts = {w.lower() for t in others or () for w in _TOKEN.findall(t)}
        self._know({w: len(g) for w, g in inside.items()}, {w: len(g) for w, g in finals.items()}, prompts, len({g for g, _ in answers}), known_share, known_least)
        self.longest, self.ends, self.breaks, self.counted = longest, ends, breaks, False
        self._follow(self.neighbours((s, m) for _, s, m in split))
        sequences = Counter(x for _, s, m in split for x in self.sequences(s, m))
        self.counts = self.tally(sequences.items())

    def _know(self, inside: dict[str, int], finals: dict[str, int], prompts: set[str], groups: int, known_share: float = 0.004, known_least: int = 3) -> None:
        """Known and whole words, from the groups that have a word inside, and as the last one without an end mark."""
        most = max(known_least, known_share * groups)
        starts = {w[:n] for w in inside for n in range(2, len(w))}
        inside = inside | {w: n for w, n in finals.items() if n >= known_least + 1 and w not in inside and w not in starts}
        self.known = {w for w, n in inside.items() if n >= most}
        self.whole = set(inside) | prompts
        self.starts = {w[:n] for w in self.whole for n in range(2, len(w))}
        self.tails: set[str] = set()
        whole, within = Counter(), Counter()
        for w in self.whole:
            if w.isalpha():
                padded = f"^^{w}"
                for i in range(2, len(padded)):
                    for n in (2, 3, 4):
                        if i + 1 >= n:
                            within[padded[i + 1 - n : i + 1]] += 1
                            whole[padded[i + 1 - n : i + 1]] += i == len(padded) - 1
        self.word_end = {k: whole[k] / n for k, n in within.items() if n >= 6}

    def neighbours(self, split: Iterable[tuple[list[list[str]], bool]]) -> dict[str, list[int]]:
        """Of each known word: how often it occurs, follows a rare one, and ends a sentence."""
        out: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
        for sentences, marked in split:
            for k, s in enumerate(sentences):
                for before, w in zip(["", *s], s, strict=False):
                    if w in self.known:
                        out[w][0] += 1
                        out[w][1] += bool(before) and before.isalpha() and before not in self.known
                if s and s[-1] in self.known and (marked or k + 1 < len(sentences)):
                    out[s[-1]][2] += 1
        return out

    def _follow(self, neighbours: dict[str, list[int]]) -> None:
        """Known words that nearly always follow a rare one and can end a sentence: the second parts of names."""
        self.tails = {w for w, (n, after, last) in neighbours.items() if after >= 0.8 * n and last >= 0.08 * n}

    def sequences(self, sentences: list[list[str]], marked: bool) -> Iterator[tuple[str, bool]]:
        """The classes of each sentence, and whether its end counts as one."""
        for k, s in enumerate(sentences):
            # perhaps the last word is a part of one
            part = k + 1 == len(sentences) and not marked and bool(s) and s[-1] not in self.whole
            yield " ".join(self.classes(s[:-1] if part else s)), not part

    def tally(self, sequences: Iterable[tuple[tuple[str, bool], int]], of: set[str] | None = None) -> dict[str, tuple[int, int]]:
        """How often each context (of those in ``of``) ended and was seen."""
        out: dict[str, tuple[int, int]] = {}
        for (sequence, ends), n in sequences:
            classes = sequence.split()
            for i in range(1, len(classes) + 1):
                for c in self.contexts(classes[:i]):
                    if of is None or c in of:
                        ended, seen = out.get(c, (0, 0))
                        out[c] = (ended + n * (ends and i == len(classes)), seen + n)
        return out

    def classes(self, words: list[str]) -> list[str]:
        out: list[str] = []
        for w in words:
            if any(c.isdigit() for c in w):
                out.append("#")
            elif w in ",;:":
                out.append(w)
            elif w not in self.known:
                out.append("_")
            elif not (w in self.tails and out and out[-1] == "_"):
                out.append(w)
        return out

    def contexts(self, before: list[str]) -> Iterator[str]:
        """From the longest: the whole sentence so far, the same with any last words, then its last words only."""
        yield "^ " + " ".join(before)
        for n in range(1, min(4, len(before) - 2)):
            yield f"*{n} " + " ".join(before[:-n])
        for n in range(min(self.longest, len(before)), 0, -1):
            yield " ".join(before[-n:])

    def end_evidence(self, words: list[str], own: dict[str, tuple[int, int]] | None = None) -> float:
        """Log likelihood ratio of an end against a break after these words of the last sentence: a sequential test over
        contexts from the longest, less the text's ``own`` occurrences."""
        total = 0.0
        for c in self.contexts(self.classes(words)):
            ended, seen = self.counts.get(c, (0, 0))
            if own and c in own:
                ended, seen = max(0, ended - own[c][0]), max(0, seen - own[c][1])
            most = 4.0 if c[0] == "^" else 2.5 if c[0] == "*" else min(4.0, 0.8 * (c.count(" ") + 1))
            total += max(-most, min(most, ended * math.log(self.ends / self.breaks) + (seen - ended) * math.log((1 - self.ends) / (1 - self.breaks))))
            if abs(total) >= 3:
                break
        return total

    def word_end_rate(self, word: str) -> float:
        padded = f"^^{word}"
        for n in (4, 3, 2):
            if (k := padded[-n:]) in self.word_end:
                return self.word_end[k]
        return 0.0

    def breaks_off(self, shown: str, prompt: str = "", word_rate: float = 0.12) -> bool:
        """Whether the text stops inside a word or phrase. A missing end mark alone says nothing."""
        if _BROKEN_OFF.search(shown):
            return True
        if _END.search(shown):
            return False
        words = _TOKEN.findall(_SENTENCE.split(shown)[-1].lower())
        if not words:
            return False
        last = words[-1]
        if last in ",;:":
            return True
        if last not in self.whole and last.isalpha():
            near = {w.lower() for w in _TOKEN.findall(prompt)} | {w.lower() for w in _TOKEN.findall(shown)[:-1]}
            if last not in near and (last in self.starts or any(w.startswith(last) for w in near) or self.word_end_rate(last) < word_rate):
                return True
        own = None
        if self.counted:
            own = self.tally(Counter(self.sequences(*sentences_of(shown))).items(), set(self.contexts(self.classes(words))))
        return self.end_evidence(words, own) < 0


_COPY_WORD = re.compile(r"[^\W_]+")


def copied_shares(prompts: list[str], answers: list[str], least: float = 0.4) -> np.ndarray:
    """The part of each prompt's words that one stretch of the answer repeats; 0 where the answer is too short for ``least``."""
    out = np.zeros(len(prompts))
    todo = []
    for k, (p, a) in enumerate(zip(prompts, answers, strict=True)):
        n, m = len(_COPY_WORD.findall(p)), len(_COPY_WORD.findall(a))
        if n >= 4 and m >= least * n:
            todo.append((n, m, k))
        elif 0 < n < 4 and n == m:
            out[k] = float(_COPY_WORD.findall(p.lower()) == _COPY_WORD.findall(a.lower()))
    todo.sort()
    while todo:
        part, cells = [], 0
        while todo and (not part or cells < 100_000):
            part.append(todo.pop())
            cells += part[-1][1]
        left = np.full((len(part), max(n for n, _, _ in part)), -1, np.int64)
        right = np.full((len(part), max(m for _, m, _ in part)), -2, np.int64)
        for r, (n, m, k) in enumerate(part):
            ids: dict[str, int] = {}
            left[r, :n] = [ids.setdefault(w, len(ids)) for w in _COPY_WORD.findall(prompts[k].lower())]
            right[r, :m] = [ids.setdefault(w, len(ids)) for w in _COPY_WORD.findall(answers[k].lower())]
        for (n, _, k), found in zip(part, align(left, right).tolist(), strict=True):
            out[k] = found / n
    return out


def _judge(languages: Languages, endings: Endings, refuses: Refusals, margin: float, copied: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prompts = [visible(t) for t in b.column("prompt").to_pylist()]
            shown = [visible(t) for t in b.column("response").to_pylist()]
            defect: list[str | None] = [EMPTY if is_empty(s) else REFUSAL if refuses(s, p) else None for p, s in zip(prompts, shown, strict=True)]
            at = [i for i, d in enumerate(defect) if d is None and prompts[i]]
            if at:
                share = copied_shares([prompts[i] for i in at], [shown[i] for i in at])
                p, r = languages.scores([prompts[i] for i in at]), languages.scores([shown[i] for i in at])
                own = p.argmax(1)
                against = r.max(1) - r[np.arange(len(at)), own]
                for k, i in enumerate(at):
                    if share[k] >= copied:
                        defect[i] = COPY
                    elif against[k] >= margin:
                        defect[i] = OTHER_LANGUAGE
            for i, d in enumerate(defect):
                if d is None and endings.breaks_off(shown[i], prompts[i]):
                    defect[i] = TRUNCATED
            keep = [i for i, d in enumerate(defect) if d]
            if not keep:
                continue
            yield pa.record_batch([b.column("source").take(keep), b.column("id").take(keep), pa.array([defect[i] for i in keep], pa.string())], names=["source", "id", "defect"])

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, response) -> (group, words, marked) of those that are not empty, refusals or visibly broken off: words with a
    space between them, sentences with a line end."""
    for b in batches:
        got = []
        for g, t in zip(b.column("group").to_pylist(), b.column("response").to_pylist(), strict=True):
            if not is_empty(s := visible(t)) and not looks_like_refusal(s) and not _BROKEN_OFF.search(s):
                sentences, marked = sentences_of(s)
                got.append((g, "\n".join(" ".join(x) for x in sentences), marked))
        if got:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*got, strict=True), (pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["group", "words", "marked"])


def _split(b: pa.RecordBatch) -> Iterator[tuple[list[list[str]], bool]]:
    for words, marked in zip(b.column("words").to_pylist(), b.column("marked").to_pylist(), strict=True):
        yield [s.split() for s in words.split("\n")], marked


def _rows(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = {(w, last, g) for g, x in zip(b.column("group").to_pylist(), _split(b), strict=True) for w, last in words_in(*x)}
        yield _rows(list(got), word=pa.string(), last=pa.bool_(), group=pa.int64())


def _prompt_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        count = Counter(w for t in set(b.column(0).to_pylist()) for w in _TOKEN.findall(t.lower()))
        yield _rows(list(count.items()), word=pa.string(), n=pa.int64())


def fit_endings(pairs: DataFrame, words: int = 300_000, contexts: int = 1_000_000) -> Endings:
    """Learned from all responses that are not empty, refusals or visibly broken off, repeated rows once. The few that break off
    without a mark end where most others go on. Only contexts that some unmarked text ends with are counted. Bounds, by
    frequency: the words of responses and as many of prompts, and the contexts, that are in most texts."""
    rows = pairs.where("response is not null").select("source", "id", F.col("group").cast("long").alias("group"), "prompt", "response").distinct()
    answers = materialize(rows.select("group", "response").mapInArrow(_answers, "group long, words string, marked boolean"), "answers")
    each = answers.mapInArrow(_words, "word string, last boolean, group long").distinct().groupBy("word", "last").agg(F.count("*").alias("n"))
    found = each.orderBy(F.desc("n"), "word").limit(words).collect()
    asked = pairs.where("response is not null and prompt is not null").select("prompt").distinct().mapInArrow(_prompt_words, "word string, n long")
    prompts = asked.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(words).collect()
    e = Endings([])
    groups = answers.select("group").distinct().count()
    e._know({r.word: r.n for r in found if not r["last"]}, {r.word: r.n for r in found if r["last"]}, {r.word for r in prompts}, groups)
    e.counted = True

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows([(w, *n) for w, n in e.neighbours(_split(b)).items()], word=pa.string(), n=pa.int64(), after=pa.int64(), last=pa.int64())

    near = answers.mapInArrow(neighbours, "word string, n long, after long, last long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "after", "last")])
    e._follow({r.word: (r.n, r.after, r["last"]) for r in near.collect()})

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = Counter(x for t in _split(b) for x in e.sequences(*t))
            yield _rows([(*k, n) for k, n in got.items()], classes=pa.string(), ends=pa.bool_(), n=pa.int64())

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = Counter(c for s, marked in _split(b) if not marked and s[-1] for c in e.contexts(e.classes(s[-1])))
            yield _rows(list(got.items()), context=pa.string(), n=pa.int64())

    asked = answers.where("not marked").mapInArrow(ends, "context string, n long").groupBy("context").agg(F.sum("n").alias("n"))
    of = {r.context for r in asked.orderBy(F.desc("n"), "context").limit(contexts).collect()}

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = e.tally((((c, x), n) for c, x, n in zip(*(c.to_pylist() for c in b.columns), strict=True)), of)
            yield _rows([(k, *n) for k, n in got.items()], context=pa.string(), ended=pa.int64(), seen=pa.int64())

    told = answers.mapInArrow(sequences, "classes string, ends boolean, n long").groupBy("classes", "ends").agg(F.sum("n").alias("n"))
    total = told.mapInArrow(counts, "context string, ended long, seen long").groupBy("context").agg(F.sum("ended").alias("ended"), F.sum("seen").alias("seen"))
    e.counts = {r.context: (r.ended, r.seen) for r in total.collect()}
    return e


def defective_pairs(pairs: DataFrame, languages: Languages, endings: Endings, refuses: Refusals, margin: float = 4.0, copied: float = 0.47) -> DataFrame:
    """(source, id, defect) of the defective among (source, id, prompt, response)."""
    given = pairs.select(F.col("source").cast("string").alias("source"), F.col("id").cast("long").alias("id"), F.col("prompt").cast("string").alias("prompt"), F.col("response").cast("string").alias("response"))
    return given.mapInArrow(_judge(languages, endings, refuses, margin, copied), "source string, id long, defect string").distinct()
