"""One identity of a file: listing, manifest and lineage meet by the ends of their paths."""

import hashlib
import json

import pytest

from assayline.operators.lineage import with_lineage
from assayline.plans import audits
from assayline.sources import files
from assayline.sources.identity import match_paths


def matched(spark, wanted, found):
    frame = [spark.createDataFrame([(p,) for p in paths], "path string") for paths in (wanted, found)]
    return {r.wanted: (r.found, r.state) for r in match_paths(*frame).collect()}


@pytest.mark.parametrize(("wanted", "found", "want"), [
    (["data/a.parquet", "data/b.parquet"], ["file:/dl/data/a.parquet", "file:/dl/data/b.parquet"], {0: 0, 1: 1}),
    (["a/x", "x"], ["s3://bucket/dl/a/x", "s3://bucket/dl/x"], {0: 0, 1: 1}),  # nested equal names
    (["t/a/x", "t/b/x"], ["/dl/b/x"], {0: "missing", 1: 0}),
    (["a/x", "b/x"], ["/dl/c/x"], {0: "ambiguous", 1: "ambiguous"}),
    (["a/x"], ["/dl/a/x", "/old/a/x"], {0: "ambiguous"}),
    (["a/x", "x"], ["/dl/a/x", "/dl/p/x", "/dl/q/x"], {0: 0, 1: "ambiguous"}),
    (["deep/er/a/x", "a//./y"], ["x", "/r/a/y"], {0: 0, 1: 1}),
    (["a/x", "a/x", None], ["/dl/a/x", "/dl/a/x", None], {0: 0}),  # repeated rows
    (["a/x"], [], {0: "missing"}),
    ([], ["/dl/a/x"], {}),
])
def test_paths_meet_by_their_ends(spark, wanted, found, want):
    got = matched(spark, wanted, found)
    assert got == {wanted[k]: (found[v], "matched") if isinstance(v, int) else (None, v) for k, v in want.items()}


@pytest.fixture(scope="module")
def shards(spark, tmp_path_factory):
    """Files of equal names at three depths, and a manifest that names them below another folder."""
    root = tmp_path_factory.mktemp("dl")
    listed = []
    for k, name in enumerate(("data/a.parquet", "data/b.parquet", "data/more/a.parquet", "data/more of it/100%/a.parquet")):
        spark.range(k + 1).selectExpr("id", "cast(id as string) as document_id").coalesce(1).write.parquet(str(root / f"w{k}"))
        raw = next((root / f"w{k}").glob("*.parquet")).read_bytes()
        (root / "dl" / name).parent.mkdir(parents=True, exist_ok=True)
        (root / "dl" / name).write_bytes(raw)
        listed.append({"path": f"mirror/{name}", "size_bytes": len(raw), "lfs_sha256": hashlib.sha256(raw).hexdigest()})
    (root / "m.json").write_text(json.dumps({"revision": "r", "shards": listed}))
    return root


@pytest.mark.parametrize(("globs", "want"), [
    (("dl",), 4), (("dl/data",), 4), (("dl/data/*.parquet",), 2), (("dl/*/*.parquet",), 2), (("dl/data/*/*.parquet", "dl/data/*.parquet"), 3),
    (("dl/data/*.parquet", "dl/data/a.parquet"), 2)])
def test_the_way_files_are_listed_does_not_matter(spark, shards, globs, want):
    out = audits.verify_source(spark, str(shards / "m.json"), *[str(shards / g) for g in globs])
    summary = out["summary"].first()
    assert (summary.expected_files, summary.found_files, summary.verified_files, summary.ambiguous_files) == (4, want, want, 0)
    assert summary.verified is (want == 4)
    assert all(r.sha256_matches for r in out["files"].where("file_exists").collect())


@pytest.mark.parametrize("root", ["dl", "dl/data", "elsewhere"])
def test_lineage_names_the_same_files(spark, shards, root):
    listed = files.manifest_shards(files.read_manifest(spark, str(shards / "m.json")))
    scan = spark.read.option("recursiveFileLookup", "true").parquet(str(shards / "dl"))
    got = {(r.lineage.file, r.lineage.revision, r.lineage.shard_hash) for r in with_lineage(scan, listed, str(shards / root), keys=("id",)).collect()}
    assert got == {(r.file, "r", r.expected_sha256) for r in listed.collect()}
