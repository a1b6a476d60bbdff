"""PII: base patterns, and information-theoretic sanitisation of terms that reveal what they found.

Protected entities are the values the base patterns find. A term is a word; it co-occurs with an entity
where it stands among the WINDOW words before or after one of its mentions or within it, each occurrence
counted once for an entity. From counts over the whole corpus a term t leaves -log2 P(e | t) bits of uncertainty about
entity e, with P(e | t) = n(t by e) / (n(t) + PRIOR): both sides count occurrences, and the prior stands for
occurrences elsewhere that the corpus has not shown. A term that leaves at most BITS bits about some entity
discloses it: it is generalised wherever it occurs. So a name that stands only beside one address goes, even
if it stands there once, and a word that stands by an address now and then stays.

Occurrences in some of the texts are a part of all: a term that leaves more than BITS bits by them alone is
refuted at once. So texts with mentions are counted first, then one in PART, and only terms that neither refutes
are counted in all texts, from which alone n(t) is taken: common words cost no row per task.

Counts, candidates and disclosing terms are tables. What travels with the tasks is of fixed size: a Bloom
filter, which only saves rows, and up to FLAGGED_MOST hashes of disclosing terms. If there are more, each
text meets its own terms in a join; the result is the same.

Defined results: null and empty texts have no spans; repeated rows each get a result; a term inside a
base span is not a span of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import arrow_map, table, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")
TERM = re.compile(r"[^\W\d_]+")
#: Words either side of a mention, bits of uncertainty below which a term discloses, occurrences assumed elsewhere.
WINDOW, BITS, PRIOR = 8, 1.0, 0.5
#: Bits of the Bloom filter, and disclosing terms up to which their hashes travel with the tasks.
BLOOM_BITS, FLAGGED_MOST = 1 << 23, 1_000_000
#: One text in so many is counted before all are; it changes no result.
PART = 16


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the base patterns' matches, by start and then kind. Linear in the text."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        m = HOST.match(text, at) if begin < at else None
        if m:
            found.append(("email", begin, m.end()))
        # no local part crosses an @, so the next one cannot begin before it
        last = m.end() if m else at + 1
        at = text.find("@", last)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if len(d := DIGITS.sub("", m[0])) in range(12, 20) and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def near_terms(text: str) -> Counter:
    """(entity, term) by the occurrences of the term near the entity, each once."""
    out: Counter = Counter()
    base = base_spans(text)
    if not base:
        return out
    tokens, own = list(TERM.finditer(text)), free_terms(text, base)
    ends, all_starts, starts = [m.end() for m in tokens], [m.start() for m in tokens], [m.start() for m in own]
    counted = set()
    for kind, start, end in base:
        value = text[start:end].lower() if kind != "card" else DIGITS.sub("", text[start:end])
        entity = key(f"{kind}:{value}")
        before, after = bisect_left(starts, start), bisect_left(starts, end)
        beside = [*own[max(0, before - WINDOW) : before], *own[after : after + WINDOW]]
        for m in (*beside, *tokens[bisect_right(ends, start) : bisect_left(all_starts, end)]):
            if (entity, m.start()) not in counted:
                counted.add((entity, m.start()))
                out[entity, m[0].lower()] += 1
    return out


def free_terms(text: str, base: list[tuple[str, int, int]]) -> list[re.Match]:
    """The words outside base spans."""
    out, k, reach = [], 0, 0
    for m in TERM.finditer(text):
        while k < len(base) and base[k][1] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if reach <= m.start():
            out.append(m)
    return out


def words(text: str | None) -> list[str]:
    """All words in lower case."""
    text = text or ""
    low = text.lower()
    return TERM.findall(low) if len(low) == len(text) else [w.lower() for w in TERM.findall(text)]


def key(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


class Bloom:
    """A set of 64-bit keys of fixed size that may also say yes to others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.uint64)
        return np.concatenate([k % np.uint64(BLOOM_BITS), (k >> np.uint64(32)) % np.uint64(BLOOM_BITS)]).astype(np.int64)

    @classmethod
    def of(cls, keys: DataFrame) -> Bloom:
        """Of a table with the column key, filled by partition; BLOOM_BITS / 8 bytes from each of 16 tasks come to the driver."""

        def fill(batches):
            bits = np.zeros(BLOOM_BITS, bool)
            for b in batches:
                bits[cls.places(b.column(0).to_numpy())] = True
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

        def both(batches):
            total = np.zeros(BLOOM_BITS // 8, np.uint8)
            for b in batches:
                for x in b.column(0):
                    total |= np.frombuffer(x.as_py(), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["bits"])

        rows = keys.select("key").mapInArrow(fill, "bits binary").repartition(16).mapInArrow(both, "bits binary").collect()
        return cls(np.bitwise_or.reduce([np.frombuffer(r.bits, np.uint8) for r in rows] or [np.zeros(BLOOM_BITS // 8, np.uint8)]))

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys).reshape(2, -1)
        return ((self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(0)


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """term, key, entity, n_near, n_all, bits of the terms that leave at most BITS bits, a written table."""

    def beside(cols):
        total, texts = Counter(), []
        for t in cols[0]:
            if found := near_terms(t or ""):
                total.update(found)
                texts.append(t)
        # the row without an entity counts the term in these texts
        terms, there = {t for _, t in total}, Counter()
        for t in texts:
            there.update(w for w in words(t) if w in terms)
        return [[e for e, _ in total] + [None] * len(there), [*(t for _, t in total), *there], [*total.values(), *there.values()]]

    pairs = arrow_map(docs.select("text"), "entity long, term string, n long", beside).groupBy("entity", "term").agg(F.sum("n").alias("n"))
    mention, there = F.when(F.col("entity").isNotNull(), F.struct("n", "entity")), F.when(F.col("entity").isNull(), F.col("n"))
    best = pairs.groupBy("term").agg(F.max(mention).alias("best"), F.coalesce(F.max(there), F.lit(0)).alias("there"))
    best = best.where(may_disclose(F.col("best.n"), F.col("there")))
    keyed = arrow_map(best.select("term", F.col("best.entity").alias("entity"), F.col("best.n").alias("n")), "term string, key long, entity long, n long", lambda c: [c[0], [key(t) for t in c[0]], c[1], c[2]])
    near = written(keyed, "pii-near")
    some = totals(docs.where(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0), near)
    live = near.join(some.hint("merge"), "key", "left").where(may_disclose(F.col("n"), F.coalesce("n_all", F.lit(0))))
    candidates = written(live.select(near.columns), "pii-candidates")
    met = candidates.join(totals(docs, candidates).hint("merge"), "key").withColumn("bits", -F.log2(F.col("n") / (F.col("n_all") + PRIOR)))
    return written(met.where(F.col("bits") <= BITS).select("term", "key", "entity", F.col("n").alias("n_near"), "n_all", "bits"), "pii-terms")


def may_disclose(n, found):
    """Whether a term with n occurrences by an entity can leave BITS bits at most if it occurs at least found times; the margin is for rounding."""
    return found + PRIOR <= n * (2**BITS * (1 + 1e-9))


def totals(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, n_all: occurrences in the texts of the words with these keys; a few other words may be among them."""
    bloom = Bloom.of(keys)

    def count(batches):
        held: Counter = Counter()

        def out():
            keys = np.array([key(w) for w in held], np.int64)
            n = np.fromiter(held.values(), np.int64, len(held))
            live = bloom.may_hold(keys)
            return pa.RecordBatch.from_arrays([pa.array(keys[live]), pa.array(n[live])], names=["key", "n_all"])

        for b in batches:
            for t in b.column(0):
                held.update(words(t.as_py()))
                if len(held) > 300_000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select("text").mapInArrow(count, "key long, n_all long").groupBy("key").agg(F.sum("n_all").alias("n_all"))


class Flagged:
    """Whether a word is a disclosing term, by the sorted hashes of all of them."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.known = np.sort(keys), {}

    def __call__(self, word: str) -> bool:
        if (said := self.known.get(word)) is None:
            k = key(word)
            at = int(np.searchsorted(self.keys, k))
            if len(self.known) > 200_000:
                self.known.clear()
            said = self.known[word] = at < len(self.keys) and int(self.keys[at]) == k
        return said

    def __getstate__(self):
        return self.keys

    def __setstate__(self, keys):
        self.keys, self.known = keys, {}


def with_terms(docs: DataFrame, flagged: DataFrame, made, schema: str) -> DataFrame:
    """made(columns, flag) over the batches of docs; flag(word) says whether a word of the row's text discloses."""
    if flagged.limit(FLAGGED_MOST + 1).count() <= FLAGGED_MOST:
        flag = Flagged(flagged.select("key").toArrow().column(0).to_numpy().astype(np.int64))
        return arrow_map(docs, schema, lambda cols: made(cols, [flag] * len(cols[0])))
    bloom = Bloom.of(flagged)

    def candidates(cols):
        out = [[], []]
        for text, t in zip(*cols):
            found = [key(w) for w in set(words(t))]
            keep = bloom.may_hold(np.array(found, np.int64)) if found else []
            out[1] += [k for k, yes in zip(found, keep) if yes]
            out[0] += [text] * int(sum(keep))
        return out

    mark = F.xxhash64("text", F.length("text"))
    own = arrow_map(docs.select(mark.alias("mark"), "text"), "mark long, key long", candidates).distinct().join(flagged.select("key").hint("merge"), "key")
    lists = own.groupBy("mark").agg(F.collect_list("key").alias("_keys"))
    rows = docs.withColumn("_mark", mark).join(lists.withColumnRenamed("mark", "_mark").hint("merge"), "_mark", "left").select(*docs.columns, "_keys")

    def each(cols):
        return made(cols[:-1], [lambda w, own=frozenset(k or ()): key(w) in own for k in cols[-1]])

    return arrow_map(rows, schema, each)


def all_spans(text: str, flag) -> tuple[list, list]:
    """Base spans, and base and term spans together by start."""
    base = base_spans(text)
    if not any(flag(w) for w in set(words(text))):
        return base, base
    extra = [("term", m.start(), m.end()) for m in free_terms(text, base) if flag(m[0].lower())]
    return base, sorted(base + extra, key=lambda s: (s[1], (*KINDS, "term").index(s[0])))


def joined(spans) -> str:
    return ",".join([f"{k}:{s}:{e}" for k, s, e in spans])


def sanitised(text: str, spans) -> str:
    """The text with each span as its kind in brackets; of overlapping spans the outline as the first's kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the kinds, base_sha256, spans, n_terms for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(cols, flags):
        out = [cols[0], *[[] for _ in range(7)]]
        for t, flag in zip(cols[1], flags):
            base, spans = all_spans(t or "", flag)
            n = Counter(k for k, _, _ in spans)
            for c, x in zip(out[1:], (*[n[k] for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n["term"])):
                c.append(x)
        return out

    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long"
    return with_terms(docs.select("doc_id", "text"), disclosing_terms(docs), each, schema)


def without_pii(docs: DataFrame) -> DataFrame:
    """docs with their spans generalised in text, and n_chars of the new text; a null text stays null."""
    at = docs.columns.index("text")

    def each(cols, flags):
        return [*cols[:at], [None if t is None else sanitised(t, all_spans(t, flag)[1]) for t, flag in zip(cols[at], flags)], *cols[at + 1 :]]

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return with_terms(docs, disclosing_terms(docs), each, schema).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document: base spans, and the terms that disclose them."""
    return pii_spans(table(spark, sf_dir, "documents"))
