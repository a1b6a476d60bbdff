from tokenizers import Tokenizer

from folio.llm import bpe

ODD = ["", None, "a" * 40 + " b", "́x é ́", "ΟΔΟΣ Σ İi", "a\x1cb\x1fc\x85d", "<|endoftext|> x<|endoftext|>y", "It's 12,5 DON'T ''ll", "Été déjà_vu  été", "一二 3"]


def test_chunks_equal_library():
    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    coder = bpe.WordBpe(bpe.vocabulary())
    for texts in (ODD, ODD[::-1], ["\n".join(x or "" for x in ODD)], [], [None]):
        want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert [[int.from_bytes(x[i : i + 2], "little") for i in range(0, len(x), 2)] for x in coder.encode(texts)] == want


def test_each_different_chunk_is_looked_up_once():
    class Counting(dict):
        looked = 0

        def __getitem__(self, k):
            self.looked += 1
            return super().__getitem__(k)

        __missing__ = None

    coder = bpe.WordBpe(bpe.vocabulary())
    coder.cache = Counting()
    coder.encode(["one two three"] * 1000)
    assert coder.cache.looked <= 6
