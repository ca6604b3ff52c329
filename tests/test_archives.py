"""Archives against Python's tarfile, JPEG headers against their bytes, gated parameters."""

import gzip
import io
import struct
import tarfile

import pytest
from pyspark.sql import functions as F

from bayline.sources import archives, headers, parameters


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("archives")
    for n in range(3):
        with tarfile.open(out / f"day{n}.tar{'.gz' if n else ''}", "w:gz" if n else "w") as archive:
            for i in range(20):
                body = f"{n}-{i}".encode() * i
                for name in (f"PKLot/site{i % 2}/{n}-{i}.jpg", f"notes/{n}-{i}.txt"):
                    member = tarfile.TarInfo(name)
                    member.size = len(body)
                    archive.addfile(member, io.BytesIO(body))
            for name in ("../up.jpg", "/absolute.jpg", "PKLot/../../x.jpg"):
                archive.addfile(tarfile.TarInfo(name), io.BytesIO(b""))
            for kind in (tarfile.SYMTYPE, tarfile.LNKTYPE, tarfile.DIRTYPE):
                member = tarfile.TarInfo(f"PKLot/odd{kind.decode()}.jpg")
                member.type, member.linkname = kind, "/etc/passwd"
                archive.addfile(member)
    (out / "readme.md").write_text("no archive")
    return out


def plain(folder, wanted=lambda n: True):
    rows = []
    for path in sorted(folder.glob("day*")):
        with tarfile.open(path) as archive:
            rows += [(i, m.name, m.size, archive.extractfile(m).read()) for i, m in enumerate(archive) if m.isfile() and archives.safe_path(m.name) and wanted(m.name)]
    return sorted(rows)


def test_members_equal_those_of_tarfile(spark, folder):
    found = archives.archive_members(spark, f"file://{folder}")
    assert found.rdd.getNumPartitions() == 3
    assert sorted((r.position, r.path, r.size, bytes(r.content)) for r in found.collect()) == plain(folder)
    assert len(plain(folder)) == 120 and found.select("archive").distinct().count() == 3
    one = archives.archive_members(spark, f"file://{folder}/day1.tar.gz", content=False)
    assert one.count() == 40 and one.where("content is not null").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        archives.archive_members(spark, f"file://{folder}/nowhere.tar").count()


def test_predicates_reach_the_reader(spark, folder):
    found = archives.archive_members(spark, f"file://{folder}").where(F.col("path").startswith("PKLot/site1/") & F.col("path").endswith(".jpg") & (F.col("size") > 9))
    assert sorted((r.position, r.path, r.size, bytes(r.content)) for r in found.collect()) == [r for r in plain(folder, lambda n: n.startswith("PKLot/site1/")) if r[2] > 9]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan tar-members" in plan and "size" in plan.split("BatchScan")[0]
    assert "StartsWith" not in plan and "EndsWith" not in plan  # the reader has taken them over


def test_samples_of_partitions(spark, folder):
    names = archives.archive_members(spark, f"file://{folder}", content=False).select("path")
    split = F.when(F.col("path").startswith("PKLot/site0"), "train").when(F.col("path").startswith("PKLot/site1"), "holdout")
    partitions = names.withColumn("partition", split).where("partition is not null")
    found = archives.sampled_members(spark, f"file://{folder}", partitions, {"train": 4, "holdout": 100})
    by = {n: {r.path: bytes(r.content) for r in found.where(F.col("partition") == n).collect()} for n in ("train", "holdout")}
    bodies = {name: body for _, name, _, body in plain(folder)}
    assert len(by["train"]) == 4 and len(by["holdout"]) == 30 and all(bodies[p] == c for x in by.values() for p, c in x.items())
    assert archives.sampled_members(spark, f"file://{folder}", partitions.limit(0), {"train": 4}).count() == 0


def jpeg(width, height, marker=0xC0, before=b"", fill=b""):
    app = b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9)
    frame = struct.pack(">HBHHB", 17, 8, height, width, 3) + bytes(9)
    return b"\xff\xd8" + app + before + fill + bytes([0xFF, marker]) + frame + b"\xff\xda" + bytes(3000)


def test_jpeg_sizes(spark, tmp_path):
    table = b"\xff\xc4" + struct.pack(">H", 40) + b"\xff\xc0" * 19  # a table whose bytes look like a frame
    files = {
        "baseline.jpg": jpeg(640, 480), "progressive.jpg": jpeg(3, 65535, 0xC2), "table.jpg": jpeg(10, 20, before=table), "filled.jpg": jpeg(7, 8, fill=b"\xff\xff"),
        "short.jpg": jpeg(640, 480)[:25], "scan.jpg": b"\xff\xd8\xff\xda" + bytes(40), "png.jpg": b"\x89PNG" + bytes(40), "empty.jpg": b"", "far.jpg": jpeg(5, 6, before=(b"\xff\xe1" + struct.pack(">H", 65535) + bytes(65533)) * 3),
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    found = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in headers.jpeg_sizes(spark, f"file://{tmp_path}").collect()}
    nothing = (None, None)
    assert found == {
        "baseline.jpg": (640, 480), "progressive.jpg": (3, 65535), "table.jpg": (10, 20), "filled.jpg": (7, 8), "far.jpg": (5, 6),
        "short.jpg": nothing, "scan.jpg": nothing, "png.jpg": nothing,
    }


def test_headers_are_read_by_seeking():
    class Counting(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            out = super().read(n)
            self.read_bytes += len(out)
            return out

    stream = Counting(jpeg(5, 6, before=(b"\xff\xe1" + struct.pack(">H", 65535) + bytes(65533)) * 3))
    assert headers.frame_size(stream) == (5, 6) and stream.read_bytes < 100


def test_gates_of_parameters(spark):
    good = {"intercept": 0.5, "z": 1.25}
    rows = parameters.parameter_rows(spark, "v1", good)
    table = rows.unionByName(parameters.parameter_rows(spark, "v2", {"intercept": float("nan"), "z": 1.0}))
    table = table.unionByName(parameters.parameter_rows(spark, "v3", {"intercept": 1.0})).unionByName(parameters.parameter_rows(spark, "v4", good).withColumn("value", F.col("value") + 1))
    table = table.unionByName(parameters.parameter_rows(spark, "v5", good).withColumn("schema_version", F.lit(9)))
    found = {r.version: (r.reason, dict(r.weights or {})) for r in parameters.gated(table, ["intercept", "z"]).collect()}
    assert found == {"v1": (None, good), "v2": ("not_finite", {}), "v3": ("wrong_names", {}), "v4": ("wrong_digest", {}), "v5": ("wrong_schema", {})}
    scored = parameters.scored(spark.createDataFrame([(1, "v1", 2.0), (2, "v4", 2.0), (3, None, 2.0)], "id long, version string, z double"), table, ["z"])
    assert {r.id: r.score and round(r.score, 9) for r in scored.collect()} == {1: 0.952574127, 2: None, 3: None}


def test_archives_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"d/{i}.html", b"x" * i if i else None) for i in range(50)], "name string, body binary").repartition(4)
    packed = archives.write_archives(rows, f"file://{tmp_path}/out", "name", "body").collect()
    assert sum(r.members for r in packed) == 50
    found = archives.archive_members(spark, f"file://{tmp_path}/out")
    assert sorted((r.path, r.size) for r in found.collect()) == sorted((f"d/{i}.html", i) for i in range(50))
    assert gzip.open(next((tmp_path / "out").glob("*.gz"))).read(2) == b"d/"
