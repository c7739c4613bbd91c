"""Personal data: patterns, and information-theoretic sanitisation of terms that reveal them.

Protected entities are the values that patterns find: the base kinds (e-mail addresses, IP addresses, card and phone
numbers), and secrets (16 characters or more assigned to a name such as token or password). A term (a word near a mention) discloses an entity as far as

    disclosure(t, e) = PMI(t; e) / IC(e),   PMI = log2(N n(t,e) / (n(t) n(e))),   IC(e) = log2(N / n(e)),

with counts over all groups of near copies of the corpus (``jaccard``; a document without copies is a group), so that
copies weigh one: 1 says that whoever reads the term can infer the entity. Terms of at least ``threshold`` for some
entity are added to the spans, wherever they occur: at ``remove_at`` or more they are removed, below it generalised.
``support`` distinct contexts are asked for, however many documents there are, so that copies of one passage prove
nothing, and a term that merely stands beside a value once isn't taken for its sign. A context is the set of the
window's other words; two are the same if they share half of all their words or more, as the copies of a passage do in
spite of edits. Of each term and entity only the first ``support`` distinct ones are kept.

A term is any run of letters and digits, however short or long, among the ``words`` nearest ones on either side of a
mention; whether it is taken out is decided by its disclosure alone (frequent words disclose nothing).

Counting. Pairs come only from windows around mentions; those with enough contexts are the candidates. One pass over
all whole texts finds where candidate terms occur: a filter of fixed size (``jaccard.bits_of``) goes to all tasks, and a
join leaves the candidates. Documents are told apart by the hash of their text, so it doesn't matter how scans are
split. Only the disclosing terms themselves go to all tasks, in lots of at most ``LOT`` (one more step for each lot).

Defined cases: null texts count as empty; repeated rows are copies; null and repeated ids don't matter; very long texts
are read whole; an empty table gives no rows; further columns, also of the names used here, are kept by ``sanitised``
and ignored elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import lean, sliced, texts_of
from tidemark.llm.jaccard import FILTER_BITS, bits_of, near_groups
from tidemark.shared import ensure_checkpoint_dir, fresh, shuffles_dropped

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
TERM = "term"
LOT = 200_000

_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where its run of digits starts, and takes whole runs: no search is repeated.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ASSIGNED = re.compile(r"""[=:]\s{0,3}["']?([A-Za-z0-9+/_-]{16,})""")
_SECRET_NAME = re.compile(r"""(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?\s{0,3}$""", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")
_NON_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from the at signs, so that long runs without one cost nothing."""
    low, at = 0, text.find("@")
    while at >= 0:
        local = _LOCAL_BACK.match(text[low:at][::-1]).end()
        m = _DOMAIN.match(text, at + 1) if local else None
        if m:
            yield at - local, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def find_base(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _NON_DIGIT.sub("", m[0])
            if 13 <= len(d) <= 19 and _luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NON_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """Values assigned to the name of a secret: (kind, start, end) in code points."""
    if "=" not in text and ":" not in text:
        return []
    return [(SECRET, *m.span(1)) for m in _ASSIGNED.finditer(text) if _SECRET_NAME.search(text, max(0, m.start() - 24), m.start())]


def _value(kind: str, raw: str) -> str:
    return f"{kind}:{_NON_DIGIT.sub('', raw) if kind in ('card', 'phone') else raw if kind == SECRET else raw.lower()}"


def _around(text: str, at: int, words: int, left: bool) -> list[tuple[int, int]]:
    """The nearest ``words`` whole words on one side of a place."""
    reach = 16 * words
    while True:
        a, b = (max(0, at - reach), at) if left else (at, min(len(text), at + reach))
        found = [(a + m.start(), a + m.end()) for m in _WORD.finditer(text[a:b])]
        whole = a == 0 if left else b == len(text)
        if found and not whole and (found[0][0] == a if left else found[-1][1] == b):
            found.pop(0 if left else -1)  # it may go on outside
        if whole or len(found) >= words:
            return found[-words:] if left else found[:words]
        reach *= 2


def _window(text: str, spans: list[tuple[str, int, int]], start: int, end: int, words: int) -> list[str]:
    """Lower-cased words on both sides of a mention, without those inside mentions."""
    near = [*_around(text, start, words, True), *_around(text, end, words, False)]
    close = [(x, y) for _, x, y in spans if near and x < near[-1][1] and near[0][0] < y]
    return [text[s:e].lower() for s, e in near if not any(x < e and s < y for x, y in close)]


def distinct_contexts(kept: list[frozenset], more: frozenset, support: int) -> bool:
    """Adds a context to those kept, unless it is one of them or they are enough; says whether it did."""
    if len(kept) >= support or any(2 * len(more & k) >= len(more | k) for k in kept):
        return False
    kept.append(more)
    return True


def cooccurrence(docs: DataFrame, text_col: str, row: str, words: int, support: int) -> DataFrame:
    """(entity, term, row, context): each pair once per document, with its context if the task hasn't enough of them; more
    rows of a pair only for further contexts; a row without a term for each entity of a document."""

    def run(batches):
        lean()
        kept: dict[tuple[int, str], list[frozenset]] = {}
        for batch in (s for b in batches for s in sliced([b], 0)):
            out = []
            for number, text in zip(batch.column(1).to_pylist(), texts_of(batch, 0), strict=True):
                rows = set()
                spans = find_base(text) + find_secrets(text)
                for kind, a, b in spans:
                    e = _hash(_value(kind, text[a:b]))
                    near = _window(text, spans, a, b, words)
                    hashes = {w: _hash(w) for w in near}
                    every = frozenset(hashes.values())
                    if (e, "") not in rows:
                        rows.add((e, ""))
                        out.append((e, "", number, None))
                    for t in hashes:
                        context = every - {hashes[t]}
                        new = distinct_contexts(kept.setdefault((e, t), []), context, support)
                        if new or (e, t) not in rows:
                            rows.add((e, t))
                            out.append((e, t, number, sorted(context) if new else None))
            if len(kept) > LOT:
                kept.clear()
            if out:
                e, t, n, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(t), pa.array(n, pa.int64()), pa.array(c, pa.list_(pa.int64()))], names=["entity", "term", "row", "context"])

    return docs.select(F.col(text_col).alias("text"), F.col(row)).mapInArrow(run, "entity bigint, term string, row bigint, context array<bigint>")


def supported(pairs: DataFrame, support: int) -> DataFrame:
    """(entity, term) of at least ``support`` distinct contexts."""
    seen = pairs.filter("context is not null").select("entity", "term", "context").distinct()
    dealt = seen.repartition("entity", "term").sortWithinPartitions("entity", "term", "context")

    def run(batches):
        held, kept = None, []
        for b in batches:
            out = []
            for e, t, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (e, t) != held:
                    held, kept = (e, t), []
                if distinct_contexts(kept, frozenset(c), support) and len(kept) == support:
                    out.append(held)
            if out:
                e, t = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(t)], names=["entity", "term"])

    return dealt.mapInArrow(run, "entity bigint, term string")


def _lots(df: DataFrame, column: str, lot: int) -> Iterator[DataFrame]:
    """A table in parts of about ``lot`` rows, by a hash of one column."""
    n = df.count()
    parts = -(-n // max(1, lot // 2)) if n > lot else 1
    for i in range(parts if n else 0):
        yield df if parts == 1 else df.filter(F.pmod(F.xxhash64(column), F.lit(parts)) == i)


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


class _Maybe(dict):
    """Word, lower-cased -> may it be among those of a filter? Remembered up to a bound."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: str) -> bool:
        at = _hash(word) % FILTER_BITS
        got = bool(self.bits[at >> 3] >> (at & 7) & 1)
        if len(self) < 400_000:
            self[word] = got
        return got

    def of(self, text: str) -> list[int]:
        """Hashes of the distinct words of a text that pass."""
        return [_hash(w) for w in set(map(str.lower, set(_WORD.findall(text)))) if self[w]]


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, words) of the texts in which some of the terms (by hash ``h``) occur, and perhaps a few others: the hashes of
    those words. Whole texts of all documents; equal texts share a row and are looked at once a batch."""
    bits = bits_of(terms, "h")

    def run(batches):
        lean()
        maybe = _Maybe(bits)
        for batch in sliced(batches, 0):
            text = dict(zip(batch.column(1).to_pylist(), texts_of(batch, 0), strict=True))
            found = [(r, w) for r, t in text.items() if (w := maybe.of(t))]
            if found:
                r, w = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(w, pa.list_(pa.int64()))], names=["row", "words"])

    return docs.select("text", "row").mapInArrow(run, "row bigint, words array<bigint>")


def _hash_column(term):
    @F.arrow_udf("bigint")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([_hash(t) for t in col.to_pylist()], pa.int64())

    return run(term)


@dataclass(frozen=True)
class Rules:
    threshold: float = 0.9
    remove_at: float = 0.98
    support: int = 3
    words: int = 8


def disclosing_terms(docs: DataFrame, text_col: str = "text", rules: Rules = Rules(), distinct: bool = False) -> DataFrame:
    """(term, disclosure): terms whose disclosure of some entity reaches the threshold. ``distinct`` says that near copies
    are out already, so each text is a group of its own."""
    ensure_checkpoint_dir(docs.sparkSession)
    with shuffles_dropped(docs.sparkSession):
        return _disclosing_terms(docs, text_col, rules, distinct)


def _disclosing_terms(docs: DataFrame, text_col: str, rules: Rules, distinct: bool) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.xxhash64(text).alias("row"), text.alias("text"))
    pairs = cooccurrence(docs, "text", "row", rules.words, rules.support).checkpoint()
    strong = supported(pairs, rules.support).checkpoint()
    terms = strong.select("term").distinct().select("term", _hash_column(F.col("term")).alias("h")).checkpoint()
    mentions = pairs.select("entity", "term", "row").distinct().join(strong.select("entity").distinct(), "entity", "left_semi").checkpoint()
    held = occurrences(docs, terms).checkpoint()
    total = docs.agg(F.count_distinct("row")).first()[0]
    of = lambda df: df.withColumn("keep", F.col("row"))
    if not distinct:
        groups = near_groups(docs.select(F.struct(F.col("row").alias("id"), "row").alias("place"), "text")).distinct().filter("row <> keep").checkpoint()
        total -= groups.count()
        of = lambda df: df.join(groups, "row", "left").withColumn("keep", F.coalesce("keep", "row"))
    joint = of(mentions).groupBy("entity", "term").agg(F.count_distinct("keep").alias("joint")).checkpoint()
    entity = joint.filter("term = ''").select("entity", F.col("joint").alias("n_entity"))
    where = held.select("row", F.explode("words").alias("h")).join(terms, "h").groupBy("row", "term").agg(F.lit(1).alias("x"))
    counts = of(where).groupBy("term").agg(F.count_distinct("keep").alias("n"))
    log2 = lambda c: F.log2(c.cast("double"))
    ic = log2(F.lit(total)) - log2(F.col("n_entity"))
    pmi = log2(F.lit(total)) + log2(F.col("joint")) - log2(F.col("n")) - log2(F.col("n_entity"))
    scored = joint.join(strong, ["entity", "term"]).join(entity, "entity").join(counts, "term").select("term", F.when(ic > 0, pmi / ic).otherwise(0.0).alias("d"))
    return scored.groupBy("term").agg(F.max("d").alias("disclosure")).filter(F.col("disclosure") >= rules.threshold).checkpoint()


def term_spans(text: str, base: list[tuple[str, int, int]], flagged) -> list[tuple[str, int, int]]:
    """Occurrences of flagged words outside the base spans."""
    if not flagged or flagged.isdisjoint(map(str.lower, set(_WORD.findall(text)))):
        return []
    return [(TERM, *m.span()) for m in _WORD.finditer(text) if m[0].lower() in flagged and not any(a < m.end() and m.start() < b for _, a, b in base)]


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), lot: int = LOT, carry: bool = False) -> DataFrame:
    """doc_id, ``base_spans``, ``secret_spans`` and ``term_spans`` (arrays of kind, start, end), and with ``carry`` all
    other columns of the input instead of doc_id. Terms come in several passes if there are more than a lot of them."""
    flagged = disclosing_terms(docs, text_col, rules)
    sets = [frozenset(r["term"] for r in part.select("term").collect()) for part in _lots(flagged, "term", lot)] or [frozenset()]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    ddl = "array<struct<kind:string,start:bigint,end:bigint>>"

    def spans_udf(words):
        @F.arrow_udf(f"struct<base:{ddl},secrets:{ddl},terms:{ddl}>")
        def run(col: pa.Array) -> pa.Array:
            rows = []
            for text in col.to_pylist():
                base, secrets = find_base(text or ""), find_secrets(text or "")
                rows.append((base, secrets, term_spans(text or "", base + secrets, words)))
            return pa.StructArray.from_arrays([pa.array([_dicts(r[i]) for r in rows], span) for i in range(3)], names=["base", "secrets", "terms"])

        return run

    found, base, secrets, terms = fresh(docs, "__found", "__base", "__secrets", "__terms")
    out = docs.withColumn(found, spans_udf(sets[0])(F.col(text_col)))
    out = out.withColumn(base, F.col(found)["base"]).withColumn(secrets, F.col(found)["secrets"]).withColumn(terms, F.col(found)["terms"])
    for words in sets[1:]:
        out = out.withColumn(terms, F.array_sort(F.concat(terms, spans_udf(words)(F.col(text_col))["terms"])))
    own = {"base_spans": base, "secret_spans": secrets, "term_spans": terms}
    keep = [c for c in docs.columns if c not in own] if carry else [F.col(id_col).alias("doc_id")]
    return out.select(*keep, *[F.col(c).alias(name) for name, c in own.items()])


def _dicts(spans):
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def sanitised(docs: DataFrame, text_col: str = "text", rules: Rules = Rules(), lot: int = LOT, distinct: bool = False) -> DataFrame:
    """The same columns with personal values replaced by their kind, and disclosing terms generalised or removed.

    Overlapping spans of different kinds are replaced as one, by the first kind.
    """
    flagged = disclosing_terms(docs, text_col, rules, distinct)
    out = docs
    parts = list(_lots(flagged, "term", lot)) or [flagged]
    for i, part in enumerate(parts):
        level = {r["term"]: r["disclosure"] for r in part.collect()}
        out = out.withColumn(text_col, _clean_udf(level, rules.remove_at, i == 0)(F.col(text_col)))
    return out.select(*docs.columns)


def _clean_udf(level: dict[str, float], remove_at: float, first: bool):
    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        lean()
        return pa.array([None if t is None else clean(t, level, remove_at, first) for t in col.to_pylist()], pa.string())

    return run


def clean(text: str, level: dict[str, float], remove_at: float = 0.98, base_too: bool = True) -> str:
    base = find_base(text) + find_secrets(text) if base_too else []
    spans = sorted([(a, b, k) for k, a, b in base + term_spans(text, base, level.keys())])
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out.append(text[at:a])
            if kind != TERM:
                out.append(f"<{kind.upper()}>")
            elif level[text[a:b].lower()] < remove_at:
                out.append("<TERM>")
        at = max(at, b)
    return "".join([*out, text[at:]])
