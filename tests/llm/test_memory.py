import numpy as np

from folio.llm import nearcopies


def test_repeated_shingles_are_counted_with_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    arrays = [rng.integers(0, 50, 300, np.uint64), rng.integers(0, 900, 300, np.uint64), np.zeros(0, np.uint64)]
    x, n = np.unique(np.concatenate(arrays), return_counts=True)
    found, times = nearcopies.repeated(list(arrays))
    assert found.tolist() == x[n > 1].tolist() and times.tolist() == n[n > 1].tolist()
    held = [rng.integers(0, 1 << 63, 1_000_000, np.uint64)]
    tracemalloc.start()
    nearcopies.repeated(held)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held == [] and most < 12_000_000  # the array is 8 MB


def test_workers_give_freed_memory_back(spark):
    """A worker that has held 400 MB in small pieces is small again when its next task begins."""
    from folio.llm.common import arrow_map

    def held(cols):
        x = [bytes(2000) for _ in range(200_000)]
        return [[len(x)]] if cols else None

    def resident(cols):
        with open("/proc/self/status") as f:
            return [[int(next(x for x in f if x.startswith("VmRSS")).split()[1]) // 1024]]

    one = spark.range(1).coalesce(1)
    before = arrow_map(one, "mb long", resident).first().mb
    assert arrow_map(one, "n long", held).first().n == 200_000
    assert arrow_map(one, "mb long", resident).first().mb < before + 150
