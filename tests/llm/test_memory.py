"""What tasks hold in a worker."""

import subprocess
import sys

from cyclemill.llm import language_id, packing, shared

PROGRAM = """
import re
from cyclemill.llm import shared
rss = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read()).group(1)) >> 10
def run(batches):
    for n in batches:
        held = [bytes(100_000) for _ in range(n)]
        last = bytes(50_000)
        yield len(held)
        keep.append(last)  # so that the end of the heap is in use
        del held
keep, before = [], rss()
assert list(shared.lean(run)(iter([3000]))) == [3000]
print(rss() - before)
"""


def test_a_task_gives_its_memory_back():
    got = subprocess.run([sys.executable, "-c", PROGRAM], capture_output=True, text=True, check=True, env={"PYTHONPATH": sys.path[0], "PATH": "/usr/bin:/bin", "MALLOC_MMAP_THRESHOLD_": str(1 << 25)}, cwd=shared._ROOT)
    assert int(got.stdout) < 60


def test_slices_of_the_tokenizer_are_small():
    assert packing.SLICE <= shared.SLICE_BYTES


PEAK = """
import re
import numpy as np, pyarrow as pa
from cyclemill.llm import quality, shared
size = lambda what: int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read()).group(1)) >> 10
rng = np.random.default_rng(0)
words = ["".join(map(chr, x)) for x in rng.integers(97, 123, (60_000, 6))]
def batches():
    for k in range(4):
        text = [" ".join(words[i] for i in x) for x in rng.integers(0, len(words), (600, 1200))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(600 * k, 600 * k + 600)), pa.array(["en"] * 600), pa.array(text)], ["row_key_", "lang", "text"])
made = list(batches())
shared.released()
before = size("VmRSS")
assert sum(len(x) for x in quality._deal(iter(made), 2400, 8))
print(size("VmHWM") - before)
"""


def test_peak_of_a_worker_that_deals_n_grams():
    got = subprocess.run([sys.executable, "-c", PEAK], capture_output=True, text=True, check=True, env={"PYTHONPATH": sys.path[0], "PATH": "/usr/bin:/bin", "ARROW_DEFAULT_MEMORY_POOL": "system"}, cwd=shared._ROOT)
    assert int(got.stdout) < 260


def test_slices_of_language_id_are_small():
    assert language_id.SLICE <= 1 << 20


def test_readers_and_batches_of_texts_are_small(spark):
    shared.ship(spark)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20
