import gc
import tracemalloc

import pyarrow as pa
from tokenizers import Tokenizer

from folio.llm import bpe


def test_known_chunks_take_little_memory():
    """120,000 chunks that occur once; as dict entries of text and bytes they took 160 bytes each."""
    coder = bpe.WordBpe(bpe.vocabulary())
    gc.collect()
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    for i in range(0, 120_000, 10_000):
        coder.encode([" ".join(f"w{k}" for k in range(i, i + 10_000))])
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 9_000_000


def test_forgotten_chunks_get_the_same_ids():
    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    coder = bpe.WordBpe(bpe.vocabulary(), cache_words=50)
    for i in range(30):
        texts = [f"the a, word{k} É{k % 7}x <|endoftext|> 12,5" for k in range(i * 10, i * 10 + 25)] + [None, ""]
        ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
        done = coder.encode_decode(texts)
        assert [[int.from_bytes(b[k : k + 4], "little") for k in range(0, len(b), 4)] for b, _ in done] == ids
        assert [x for _, x in done] == [t.decode(x, skip_special_tokens=False) for x in ids]
        assert len(coder.known) < 150
