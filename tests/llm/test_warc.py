"""Packages as files: several records and packages, lost attempts, large indexes, very long and hot payloads."""

import io
import os
import zipfile
from collections import Counter

from tracegraph.llm import warc

SCHEMA = "page_id long, url string, html string, length long, path string"


def test_files_are_archives_and_only_listed_ones_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 3000)
    monkeypatch.setattr(warc, "RECORDS_READ", 7)
    monkeypatch.setattr(warc, "INDEX_READ", 100)
    hot = "<p>hot</p>" * 30
    rows = [(i, f"http://x/{i}", hot if i % 3 else f"<p>{i}</p>", 0, "p") for i in range(200)] + [(200, None, "é" * 2_000_000, 0, "p"), (None, "u", hot, 0, "p"), (5, "again", hot, 0, "p")]
    packs = warc.packages(spark.createDataFrame(rows, SCHEMA).repartition(3), folder=f"file://{tmp_path}/out")
    listed = packs.collect()
    assert len(listed) > 5
    for r in listed:
        path = r["path"].removeprefix("file://")
        assert os.path.getsize(path) == r["length"]
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and all(m.compress_type == zipfile.ZIP_STORED for m in z.infolist())
    want = Counter()
    for i, url, html, *_ in rows:
        again = html == hot and i != 1
        want[i, url or "", len(html.encode()), warc.digest_of(html.encode()), "revisit" if again else "response", 1 if again else None, None if again else html.encode()] += 1
    read = lambda p: Counter((*r[:6], None if r[6] is None else bytes(r[6])) for r in warc.read_packages(p).collect())
    assert read(packs) == want
    assert read(warc.packages_at(spark, f"{tmp_path}/out")) == want
    with open(f"{tmp_path}/out/lost.wacz", "wb") as f:  # as a lost attempt leaves it
        f.write(b"PK")
    assert read(packs) == want


def test_record_of_a_package_beyond_32_bits():
    """A sparse archive whose members lie beyond 4 GiB: offsets come from ZIP64 fields, and little is read."""
    raw = warc.package([("page:1", warc.record("response", 1, "u", b"far", warc.digest_of(b"far"), 3))], zip64=True)
    gap = 5 << 30
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        start = z.start_dir
    moved = bytearray(raw)
    at = start
    for _ in range(3):  # local header offsets, the last eight bytes of the extra fields, and what the end records say
        name, extra = int.from_bytes(moved[at + 28 : at + 30], "little"), int.from_bytes(moved[at + 30 : at + 32], "little")
        p = at + 46 + name + extra - 8
        moved[p : p + 8] = (int.from_bytes(moved[p : p + 8], "little") + gap).to_bytes(8, "little")
        at += 46 + name + extra
    moved[at + 48 : at + 56] = (start + gap).to_bytes(8, "little")
    moved[at + 64 : at + 72] = (at + gap).to_bytes(8, "little")
    read = []

    def ranged(at, n):
        read.append(n)
        return bytes(moved[max(0, at - gap) : max(0, at - gap + n)]) if at >= gap else bytes(min(n, gap - at)) + bytes(moved[: max(0, at + n - gap)])

    got = list(warc.ZipPackage(ranged, gap + len(moved)).records())
    assert got[0]["payload"] == b"far" and sum(read) < 80_000
