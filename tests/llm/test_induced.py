import random
import subprocess
import sys

import numpy as np
import pytest

from sonarmill.llm.induced import Sorter


def brute(text, depth):
    order = sorted(range(len(text)), key=lambda k: text[k:])
    lcp = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        lcp.append(min(k, depth))
    return order, lcp


@pytest.mark.parametrize("seed", range(60))
def test_order_and_common_prefixes(seed, tmp_path):
    rng = random.Random(seed)
    text = [rng.randint(1, rng.choice([1, 2, 4, 30])) for _ in range(rng.randint(1, 150))]
    if seed % 3 == 0:
        text = text[: len(text) // 4 + 1] * 4
    depth = rng.choice([3, 10**6]) if len(set(text)) == 1 else 10**6
    with Sorter(depth, memory_symbols=rng.choice([2, 9, 10**6]), chunk=rng.choice([1, 5, 1000]), folder=str(tmp_path), alphabet=rng.choice([0, 4096]), resident=rng.choice([0, 1 << 20])) as sorter:
        parts = list(sorter.sort(np.array(text, np.uint16)))
    got = np.concatenate([p for p, _ in parts]).tolist(), np.concatenate([c for _, c in parts]).tolist()
    want = brute(text, depth)
    assert got[1] == want[1]
    if depth > len(text):
        assert got[0] == want[0]
    assert not list(tmp_path.iterdir())


PEAK = """
import resource, sys
import numpy as np
from sonarmill.llm.induced import Sorter
n, kind = int(sys.argv[1]), sys.argv[2]
rng = np.random.default_rng(1)
text = rng.integers(1, 200, n, dtype=np.uint16)
if kind == "repeats":
    text = np.tile(text[: n // 50], 50)
text.tofile(sys.argv[3])
text = np.memmap(sys.argv[3], np.uint16, "r")
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
total = 0
with Sorter(400, memory_symbols=1 << 14, chunk=1 << 12, resident=1 << 19) as sorter:
    for places, lcp in sorter.sort(text):
        total += len(places)
assert total == len(text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""


@pytest.mark.parametrize("kind", ["random", "repeats"])
def test_memory_does_not_grow_with_the_text(kind, tmp_path):
    """Growth of the process in MB, mapped pages included, for 150,000 and 1,500,000 symbols."""
    peaks = [float(subprocess.run([sys.executable, "-c", PEAK, str(n), kind, str(tmp_path / "text")], capture_output=True, text=True, check=True).stdout) for n in (150_000, 1_500_000)]
    assert peaks[1] < peaks[0] + 20, peaks
