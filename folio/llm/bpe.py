"""BPE encoding and decoding with a word-end vocabulary, by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks every adjacent pair up by binary
search over the sorted pair keys, takes the lowest rank of each word and merges all its
non-overlapping occurrences from the left. Words that are done leave the array.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows each
get their own result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from folio.llm.common import arrow_map, table

NONE = np.iinfo(np.int64).max
#: Fixed values of the vocabulary's pre-tokenizer.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: The same pieces of a lower-case ASCII text without white space.
ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Separators that str.split() cuts at though they are no white space to the vocabulary.
ODD_SPACES = "\x1c\x1d\x1e\x1f"


#: Letters of texts that are encoded at once, if it is more than one text.
AT_ONCE = 1_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, the others for 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a tokenizers file of kind BPE with the word end </w>."""

    def __init__(self, path: str, cache_words: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = vocab | self.special
        self.size = max(names.values()) + 1
        self.names = [""] * self.size
        for s, i in names.items():
            self.names[i] = s
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        # all occurrences of the lowest pair may be merged in one round only if a merge never makes a pair of lower rank
        latest = np.full(self.size, -1, dtype=np.int64)
        np.maximum.at(latest, made, np.arange(len(made)))
        self.ordered = bool((np.arange(len(left)) > np.maximum(latest[left], latest[right])).all())
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        # known chunks and their ids lie in flat arrays, about 40 bytes a chunk, not as objects; cache holds new ones only until they are known
        self.cache_words, self.cache = cache_words, {}
        self.known, self.ids, self.bounds, self.met = pa.array([], pa.large_string()), np.zeros(0, self.kind), np.zeros(1, np.int64), np.zeros(0, bool)

    def words(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many non-empty words in one flat array, and the bounds of each word in it."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        sym = self.first[flat]
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.last[flat[ends]]
        word = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        rank = self.pair_ranks(sym, word, np.arange(len(sym)))
        out_sym, out_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, starts)
            per = np.repeat(low, np.diff(np.r_[starts, len(sym)]))
            live = per != NONE
            if not live.all():
                out_sym.append(sym[~live])
                out_word.append(word[~live])
                sym, word, rank, per = sym[live], word[live], rank[live], per[live]
                if not len(sym):
                    break
            pick = np.flatnonzero(rank == per)
            if self.ordered:  # of a run of overlapping picks every second counts, from the left
                fresh = np.r_[True, np.diff(pick) != 1]
                begin = np.maximum.accumulate(np.where(fresh, np.arange(len(pick)), 0))
                pick = pick[(np.arange(len(pick)) - begin) % 2 == 0]
            else:
                pick = pick[np.r_[True, np.diff(word[pick]) != 0]]
            sym[pick] = self.made[rank[pick]]
            keep = np.ones(len(sym), dtype=bool)
            keep[pick + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at = pick - np.arange(len(pick))  # only the pairs beside a merge are looked up again
            rank[at] = self.pair_ranks(sym, word, at)
            at = np.maximum(at - 1, 0)
            rank[at] = self.pair_ranks(sym, word, at)
        sym, word = np.concatenate(out_sym), np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(len(pieces) + 1))

    def pair_ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that begin at the given places; NONE without one."""
        after = np.minimum(at + 1, len(sym) - 1)
        key = sym[at] * self.size + sym[after]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[place] == key) & (word[at] == word[after]) & (after > at), self.ranks[place], NONE)

    @staticmethod
    def lower(text: str) -> str:
        """Composed and in lower case letter by letter: a final sigma is no special case."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, chunk: str) -> list:
        """The words of a text without white space; a special token is its id."""
        out: list = []
        for part in self.split_special.split(chunk) if self.split_special and "<|" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                low = self.lower(part)
                if low.isalpha():
                    out.append(low.encode())
                else:
                    out += [p.encode() for p in PIECES.findall(low)]
        return out

    def learn(self, chunks: list[str]) -> None:
        """Put the chunks' ids (in the narrow type) in the cache."""
        short: dict = {}
        for ascii_only, find in ((True, ASCII_PIECES.findall), (False, None)):
            own = [c for c in chunks if c.isascii() == ascii_only and "<|" not in c]
            low = self.lower("\n".join(own))  # no chunk holds a line end, and none is made or composed across one
            for c, x, raw in zip(own, low.split("\n"), low.encode().split(b"\n")):
                short[c] = (raw,) if x.isalpha() else find(raw) if find else [p.encode() for p in PIECES.findall(x)]
        cut = [short.get(c) or self.pieces(c) for c in chunks]
        todo = list({p: None for ps in cut for p in ps if isinstance(p, bytes)})
        ids, at = self.words(todo) if todo else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        raw, width = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
        at = (at * width).tolist()
        of = {p: raw[at[i] : at[i + 1]] for i, p in enumerate(todo)}
        of |= {i: np.array([i], self.kind).tobytes() for i in self.special.values()}
        for c, ps in zip(chunks, cut):
            self.cache[c] = of[ps[0]] if len(ps) == 1 else b"".join([of[p] for p in ps])

    def chunks(self, text: str) -> list[str]:
        """The text cut at white space. No word crosses it, nor does composition."""
        return [c for c in SPACES.split(text) if c] if any(c in text for c in ODD_SPACES) else text.split()

    def remember(self, chunks: pa.Array) -> None:
        """Chunks that are not known yet follow the known ones."""
        for i in range(0, len(chunks), 20_000):
            part = chunks.slice(i, 20_000).to_pylist()
            self.learn(part)
            raw = [self.cache[c] for c in part]
            self.cache.clear()
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // self.ids.itemsize
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(raw), self.kind)])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        self.known = pa.concat_arrays([self.known, chunks])
        self.met = np.concatenate([self.met, np.zeros(len(chunks), bool)])

    def forget(self) -> None:
        """Chunks that were not met again since this was last done go; most occur once."""
        at = np.flatnonzero(self.met)
        first, many = self.bounds[at], np.diff(self.bounds)[at]
        self.known, self.ids = self.known.take(pa.array(at)), self.ids[spread(first, many)]
        self.bounds, self.met = np.concatenate([[0], np.cumsum(many)]), np.zeros(len(at), bool)

    def look_up(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in the narrow type in one flat array, and the bounds of each text in it."""
        if len(self.known) > self.cache_words:
            self.forget()
        cut = [self.chunks(t or "") for t in texts]
        sizes = np.cumsum([0, *map(len, cut)])
        # each different chunk of these texts is looked up once
        coded = pa.array(chain.from_iterable(cut), pa.large_string()).dictionary_encode()
        del cut
        place = pc.index_in(coded.dictionary, self.known)
        new, place = place.is_null().to_numpy(zero_copy_only=False), place.fill_null(-1).to_numpy().astype(np.int64)
        self.met[place[~new]] = True
        place[new] = len(self.known) + np.arange(np.count_nonzero(new))
        self.remember(coded.dictionary.filter(pa.array(new)))
        place = place[coded.indices.to_numpy()]
        first, many = self.bounds[place], self.bounds[place + 1] - self.bounds[place]
        return self.ids[spread(first, many)], np.concatenate([[0], np.cumsum(many)])[sizes]

    @staticmethod
    def groups(texts: list[str | None]) -> Iterator[list[str | None]]:
        """The texts in order, some at a time: what is made of them is a multiple of their size."""
        some, size = [], 0
        for t in texts:
            if some and size + len(t or "") > AT_ONCE:
                yield some
                some, size = [], 0
            some.append(t)
            size += len(t or "")
        if some:
            yield some

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids in the type `kind`: little-endian, unsigned, 16 bits if the vocabulary allows, else 32."""
        out = []
        for ids, at in map(self.look_up, self.groups(texts)):
            raw, at = ids.tobytes(), (at * ids.itemsize).tolist()
            out += [raw[s:e] for s, e in zip(at, at[1:])]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Token texts joined by a space, as the vocabulary has no decoder of its own."""
        return " ".join([self.names[i] for i in ids.tolist()])

    def encode_decode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Ids (little-endian unsigned 32-bit) and decoded text, which is what decode(ids) gives."""
        names, out = pa.array(self.names, pa.large_string()), []
        for ids, at in map(self.look_up, self.groups(texts)):
            decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), names.take(pa.array(ids))), pa.scalar(" ", pa.large_string())).to_pylist()
            raw, at = ids.astype("<u4").tobytes(), (at * 4).tolist()
            out += [(raw[s:e], x) for s, e, x in zip(at, at[1:], decoded)]
        return out


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of many places each."""
    ends = np.cumsum(many)
    return np.repeat(first - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids binary (little-endian unsigned 32-bit), decoded string for each row of docs(doc_id, text)."""

    def each(cols, bpe):
        done = bpe.encode_decode(cols[1])
        return [cols[0], [x[0] for x in done], [x[1] for x in done]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), f"doc_id {kind}, ids binary, decoded string", each, lambda: WordBpe(path))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """As bpe_round_trip, but digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def each(cols, bpe):
        done = bpe.encode_decode(cols[1])
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return [cols[0], [len(x[0]) // 4 for x in done], [sha(x[0]) for x in done], [sha(x[1].encode()) for x in done]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", each, lambda: WordBpe(path))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary())
