import random

import pytest
from brindle.functions import paths
from brindle.functions.similarity import jaro_winkler
from brindle.operators import dedup, hierarchy, treemap
from brindle.operators.components import components
from brindle.plans import filters
from brindle.streaming import changes
from pyspark.sql import functions as F


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "name,want", [("report (1).pdf", "report"), ("Copy of A.txt", "a"), ("a - copy (3).txt", "a - copy"), ("x ().y", "x"), (".env", ""), ("a.tar.gz", "a.tar")]
)
def test_normalized_names(spark, name, want):
    assert one(spark, paths.normalized_name(F.lit(name))) == want


@pytest.mark.parametrize("name,want", [("a.tar.gz", "gz"), (".env", None), ("a", None), ("a.", None)])
def test_extensions(spark, name, want):
    assert one(spark, paths.extension(F.lit(name))) == want


@pytest.mark.parametrize("path,want", [("C:\\", "C"), ("/", "root"), ("/mnt/data", "data"), ("\\\\wsl$\\Ubuntu\\home", "wsl:Ubuntu")])
def test_volume_ids(spark, path, want):
    assert one(spark, paths.volume_id(F.lit(path))) == want


@pytest.mark.parametrize("path,want", [("/home/u/node_modules/x", 4), ("/home/u/AppData/x", 3), ("C:\\Users\\u\\Documents", 0), ("/home/u", 1), ("/usr/lib", 2), ("/srv", 2)])
def test_scan_priority(spark, path, want):
    assert one(spark, paths.scan_priority(F.lit(path))) == want


def test_jaro_winkler():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and jaro_winkler("abc", "xyz") == 0 and jaro_winkler("", "") == 0


def test_floored_totals_never_fall_below_zero(spark):
    r = random.Random(1)
    rows = [(k, i, r.randint(-9, 9)) for k in range(5) for i in range(40)]
    want = {}
    for k, _, d in rows:
        want[k] = max(0, want.get(k, 0) + d)
    r.shuffle(rows)
    got = hierarchy.floored_totals(spark.createDataFrame(rows, "k int, s int, d long"), "k", "s", "d").collect()
    assert {x.k: x.total for x in got} == want


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_treemap_areas():
    boxes = treemap.squarify([75.0, 25.0], 0, 0, 100, 100)
    assert [round(w * h) for _, _, w, h in boxes] == [7500, 2500]
    boxes = treemap.squarify(sorted((float(i % 37 + 1) for i in range(300)), reverse=True), 0, 0, 100, 100)
    assert abs(sum(w * h for _, _, w, h in boxes) - 10000) < 1e-6 and max(max(w / h, h / w) for _, _, w, h in boxes) < 5
    cells = [(x + w / 2, y + h / 2) for x, y, w, h in boxes]
    assert all(sum(x < cx < x + w and y < cy < y + h for x, y, w, h in boxes) == 1 for cx, cy in cells)


def test_filters_survive_json():
    f = ~filters.where("tag", tag="x") & (filters.where("size", min=1, max=5) | filters.where("duplicate"))
    assert filters.Filter.from_json(f.to_json()) == f
    with pytest.raises(ValueError):
        filters.compile_filter(filters.where("nothing"))
    assert filters.parse_query("size:<2KB").parts[0].args == {"min": 0, "max": 2047}


def fold(events):
    """The state machine of one file, event by event."""
    state = None
    for e in events:
        kind = e[0]
        if isinstance(state, list):
            state = [state[0], e] if kind == "Modified" else None if kind == "Deleted" else e
        elif state and state[0] == "Created" and kind in ("Deleted", "Modified"):
            state = None if kind == "Deleted" else state
        elif state and state[0] == "Deleted" and kind == "Created":
            state = ("Modified", *e[1:])
        elif state and state[0] == "Moved" and kind == "Modified":
            state = [state, e]
        else:
            state = e
    return [] if state is None else state if isinstance(state, list) else [state]


def test_changes_fold_like_the_state_machine(spark):
    r = random.Random(3)
    rows = [("v", i, r.choice(["Created", "Deleted", "Moved", "Modified"]), r.randint(0, 40), r.randint(0, 99)) for i in range(400)]
    df = spark.createDataFrame(rows, "volume_id string, seq long, kind string, fid long, new_size long")
    got = sorted((x.fid, x.step, x.kind, x.seq, x.new_size) for x in changes.coalesce_changes(df).collect())
    want = sorted((f, i + 1, k, s, n) for f in range(41) for i, (k, s, n) in enumerate(fold([(k, s, n) for _, s, k, g, n in rows if g == f])))
    assert got == want


def test_stream_gives_what_batch_gives(spark, tmp_path):
    rows = [("v", i, ["Created", "Modified", "Moved", "Deleted"][i % 3], i % 7, None, None, i) for i in range(60)]
    spark.createDataFrame(rows, changes.EVENT).write.parquet(str(tmp_path / "in"))
    out = []
    q = changes.run_stream(spark.readStream.schema(changes.EVENT).parquet(str(tmp_path / "in")), lambda df, n: out.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    batch = changes.coalesce_changes(spark.read.parquet(str(tmp_path / "in"))).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, batch))


def test_hamming_pairs(spark):
    r = random.Random(5)
    base = [r.getrandbits(63) for _ in range(20)]
    hs = [(i, b ^ sum(1 << x for x in r.sample(range(62), r.randint(0, 5)))) for i, b in enumerate(base * 3)]
    got = {(x.a, x.b) for x in dedup.hamming_pairs(spark.createDataFrame(hs, "id long, h long"), 6).collect()}
    assert got == {(i, j) for i, a in hs for j, b in hs if i < j and (a ^ b).bit_count() <= 6}


def test_names_without_a_block_are_compared(spark):
    names = spark.createDataFrame([(1, None, "report_final"), (2, None, "report_finale"), (3, "txt", "report_final")], "id long, block string, name string")
    assert [(r.block, r.a, r.b) for r in dedup.similar_names(names).collect()] == [(None, "report_final", "report_finale")]


def test_folders_at_any_depth_have_digests(spark):
    rows = [("v", f"/{top}/b/c/d/e/{n}", 3) for top in "xy" for n in ("one", "two")] + [("v", "/x/b/other", 1)]
    got = {r.path: (r.digest, r.file_count) for r in dedup.folder_digests(spark.createDataFrame(rows, "volume_id string, path string, size_bytes long")).collect()}
    assert got["/x/b/c/d/e"][0] == got["/y/b/c/d/e"][0] and got["/x/b/c"][0] == got["/y/b/c"][0] and got["/x/b"][0] != got["/y/b"][0]
    assert got["/x"][1] == 3 and got["/y"][1] == 2
