import hashlib
import os
import random

import pytest

from tracegrain.sources.files import file_digest, tree_levels
from tracegrain.sources.ranges import deal


def plain(data: bytes, leaf: int, fan: int) -> str:
    level = [hashlib.sha256(data[i:i + leaf]).hexdigest() for i in range(0, max(1, len(data)), leaf)]
    while len(level) > 1:
        groups = [level[i:i + fan] for i in range(0, len(level), fan)]
        level = [g[0] if len(g) == 1 else hashlib.sha256("".join(g).encode()).hexdigest() for g in groups]
    return level[0]


def digests(df):
    return {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in df.collect()}


def test_tree_digest_of_any_size_and_split(spark, tmp_path):
    rng = random.Random(3)
    sizes = [0, 1, 99, 100, 101, 400, 401, 1600, 1601, 7000]
    contents = {f"f{n} x.bin": rng.randbytes(n) for n in sizes}
    for name, data in contents.items():
        (tmp_path / "k=1").mkdir(exist_ok=True)
        (tmp_path / "k=1" / name).write_bytes(data)
    for hidden in ("_SUCCESS", ".f.bin.crc"):
        (tmp_path / hidden).write_bytes(b"x")
    want = {name: (len(data), plain(data, 100, 4)) for name, data in contents.items()}
    assert want["f99 x.bin"][1] == hashlib.sha256(contents["f99 x.bin"]).hexdigest()
    for part in (100, 350, 1 << 20):
        assert digests(file_digest(spark, str(tmp_path), "*.bin", 100, 4, part)) == want
    assert digests(file_digest(spark, f"file://{tmp_path}", "f1 x*", 100, 4)) == {"f1 x.bin": want["f1 x.bin"]}


def test_file_over_two_gigabytes(spark, tmp_path):
    size = (1 << 31) + 12345
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(size)  # takes no disk
    leaf, fan = 8 << 20, 1024
    zero, rest = hashlib.sha256(bytes(leaf)).hexdigest(), hashlib.sha256(bytes(12345)).hexdigest()
    want = hashlib.sha256((zero * 256 + rest).encode()).hexdigest()
    df = file_digest(spark, str(tmp_path))
    assert digests(df) == {"big.bin": (size, want)}
    os.truncate(tmp_path / "big.bin", 0)


def test_no_files_and_no_folder(spark, tmp_path):
    assert file_digest(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="missing"):
        file_digest(spark, str(tmp_path / "missing")).count()


def test_ranges_cover_each_leaf_once():
    files = [("a", 0), ("b", 1000), ("c", 10), ("d", 330)]
    for part in (10, 50, 95, 10**6):
        seen = [(r.path, k) for runs in deal(files, 10, part) for r in runs for k in range(r.first, r.first + r.count)]
        assert seen == [(p, k) for p, n in files for k in range(max(1, -(-n // 10)))]
    assert deal([], 10, 10) == [] and tree_levels(8 << 20, 1024) == 4
