"""Adaptive time partitions against a layout worked out row by row in plain Python, and the files read back."""

import calendar
import datetime as dt
import glob
import hashlib
import zlib

import pyarrow.parquet as pq
import pytest

from sandglass.llm import registry
from sandglass.llm import time_partitions as tp

SF = "/root/testdata/sf0.001"
KIND = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, o0 string, hour int"
LATE = dt.datetime(2024, 5, 1)


def moment(click_id, ts):
    if ts is None:
        return None
    k = zlib.crc32(str(click_id).encode()) % 128 if click_id is not None else 50
    if k < 16:
        return ts - dt.timedelta(days=(k + 6) ** 3)
    if k > 111:
        return dt.datetime.combine(ts.date() - dt.timedelta(days=ts.weekday()), dt.time())
    return ts


def layout(rows, limit):
    """{(leaf, part): rows} of (moment, row) pairs: each node is split by looking at all its rows."""
    out = {}

    def leaf(name, own):
        own = sorted(own, key=lambda x: (x[0] or dt.datetime.min, x[1][2] or dt.datetime.min, -(1 << 63) if x[1][0] is None else x[1][0]))
        for i in range(0, len(own), limit):
            out[(name, 1 + i // limit)] = [r for _, r in own[i : i + limit]]

    def level(prefix, labels, depth, own, of):
        by = {label: [x for x in own if of(x[0]) == label] for label in labels}
        run, held = [], []

        def close():
            nonlocal run, held
            if held:
                leaf(f"{prefix}{run[0]}-{run[-1]}", held)
            run, held = [], []

        for label in labels:
            if len(by[label]) > limit:
                close()
                if depth == 3:
                    leaf(f"{prefix}{label}-{label}", by[label])
                else:
                    inner = [f"{i:02d}" for i in (range(1, 13), range(1, 1 + calendar.monthrange(*map(int, f"{prefix}{label}".split("/")))[1]) if depth == 1 else (), range(24))[depth]]
                    level(f"{prefix}{label}/", inner, depth + 1, by[label], (lambda m: f"{m.month:02d}", lambda m: f"{m.day:02d}", lambda m: f"{m.hour:02d}")[depth])
            elif run and len(held) + len(by[label]) <= limit:
                run.append(label)
                held = held + by[label]
            else:
                close()
                run, held = [label], by[label]
        close()

    timed = [x for x in rows if x[0] is not None]
    if timed:
        years = [f"{y:04d}" for y in range(min(timed, key=lambda x: x[0])[0].year, max(timed, key=lambda x: x[0])[0].year + 1)]
        level("", years, 0, timed, lambda m: f"{m.year:04d}")
    leaf("null", [x for x in rows if x[0] is None])
    return out


def expected(rows):
    limit = 1 + len(rows) // 500
    both = [(moment(r[0], r[1]), r) for r in rows]
    old, new = layout([x for x in both if x[1][2] is not None and x[1][2] < LATE], limit), layout(both, limit)
    show = lambda own: sorted(map(repr, own))
    out = {}
    for k, own in new.items():
        stays = k in old and show(old[k]) == show(own)
        ids = ",".join("" if r[0] is None else str(r[0]) for r in own)
        out[k] = (len(own), 0 if stays else sum(r[2] is None or r[2] >= LATE for r in own), not stays, hashlib.sha256(ids.encode()).hexdigest())
    return out, new


def held(result, rows):
    want, files = expected(rows)
    got = {(r["leaf"], r["part"]): (r["n_rows"], r["n_new"], r["rewritten"], r["ids_sha256"]) for r in result}
    assert got == want
    folders = set()
    for r in result:
        table = pq.ParquetFile(r["path"]).read()
        assert ",".join(table.column_names) == r["columns"]
        assert sorted(map(repr, zip(*[c.to_pylist() for c in table.columns]))) == sorted(map(repr, files[(r["leaf"], r["part"])]))
        ids = ["" if i is None else str(i) for i in table["click_id"].to_pylist()]
        assert hashlib.sha256(",".join(ids).encode()).hexdigest() == r["ids_sha256"]
        folders.add(r["path"].rpartition(f"/{r['leaf']}/")[0])
    if result:
        (folder,) = folders
        assert sorted(glob.glob(f"{folder}/**/*.*", recursive=True)) == sorted(r["path"] for r in result)


def test_real_clicks_and_files_read_back(spark):
    clicks = spark.read.parquet(f"{SF}/clicks.parquet")
    held(registry.queries()["op11_time_partitions"](spark, SF).collect(), [tuple(r) for r in clicks.collect()])


def made():
    """Late rows, a crowded hour with repeats whose parts recur or not, nulls, ties, old years and clashing column names."""
    day, rows = dt.datetime(2024, 3, 5, 7), []
    for i in range(1400):
        at = day + dt.timedelta(minutes=i * 37)
        rows.append((i, at, at + dt.timedelta(seconds=5 if i % 11 else 90 * 86400), i % 3, "k", 1.5, None, "x", i))
    crowd = [i for i in range(5000, 9000) if zlib.crc32(str(i).encode()) % 128 in range(16, 112)][:30]
    rows += [(i, day, day + dt.timedelta(seconds=i % 4), 1, "hot", None, "{}", None, None) for i in crowd]
    rows += [(crowd[0], day, day, 1, "hot", None, "{}", None, None)] * 40
    rows += [(crowd[-1], day, dt.datetime(2024, 6, 1), 1, "hot", None, "{}", None, None)] * 3
    rows += [(7000 + i, None, day + dt.timedelta(days=20 * i), None, None, None, None, None, None) for i in range(12)]
    rows += [(None, day, day, None, "no id", None, None, None, None), (9, day, None, None, "never arrived", None, None, None, None)]
    return rows


def test_late_rows_crowded_hours_and_odd_rows(spark):
    rows = made()
    held(tp.partition_clicks(spark.createDataFrame(rows, KIND).repartition(5)).collect(), rows)


def test_empty_table_and_all_rows_alike(spark):
    assert tp.partition_clicks(spark.createDataFrame([], KIND)).collect() == []
    one = (3, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), 1, "k", 0.0, "p", None, 1)
    held(tp.partition_clicks(spark.createDataFrame([one] * 700, KIND)).collect(), [one] * 700)


def test_other_types_and_lost_writers(spark, tmp_path):
    rows = [(dt.date(2024, 1, 1 + i % 9), i, {"a": i}, [i, None], (i, "x"), dt.datetime(2024, 1, 1, 0, i)) for i in range(40)]
    df = spark.createDataFrame(rows, "d date, id long, m map<string,int>, a array<int>, s struct<p:int,q:string>, t timestamp")
    folder = f"file://{tmp_path}/out"
    files = tp.write_layout(df, tp.micros(df["d"], df.schema["d"].dataType), ["t", "id"], "id", 7, folder)
    (tmp_path / "out/2024").mkdir(exist_ok=True)
    (tmp_path / "out/2024/.lost.writing").write_bytes(b"x")
    again = tp.write_layout(df, tp.micros(df["d"], df.schema["d"].dataType), ["t", "id"], "id", 7, folder, files)
    assert [f.path for f in again] == [f.path for f in files] and not any(f.written for f in again)
    assert not (tmp_path / "out/2024/.lost.writing").exists()
    got = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError):
        tp.write_layout(df.select("id", "id", "d"), df["id"], ["d"], "id", 7, folder)


def test_blocks_are_shuffled_not_rows(spark, monkeypatch):
    """The Python shuffle carries a block for each bucket and task, and none for files that stay."""
    from pyspark.rdd import RDD

    counts, shuffle = [], RDD.repartitionAndSortWithinPartitions

    def counted(self, *args, **kwargs):
        counts.append(self.count())
        return shuffle(self, *args, **kwargs)

    monkeypatch.setattr(RDD, "repartitionAndSortWithinPartitions", counted)
    clicks = spark.range(20000, numPartitions=2).selectExpr(
        "id click_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id % 9000) ts", "timestamp_ntz'2024-01-02' + make_dt_interval(id div 150) arrived_at", "'x' kind"
    )
    result = tp.partition_clicks(clicks, share=20).collect()
    assert sum(r["n_rows"] for r in result) == 20000
    assert len(counts) == 2 and 0 < sum(counts) <= 2 * 2 * 2 * len(result)


def laid_out(spark, rows, limit):
    df = spark.createDataFrame(rows, KIND).repartition(5)
    files = tp.write_layout(df, tp.click_moment(df), ["arrived_at", "click_id"], "click_id", limit, f"{tp.shared_dir(spark)}/buckets-{tp.uuid.uuid4().hex}")
    want = layout([(moment(r[0], r[1]), r) for r in rows], limit)
    ids = lambda own: hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in own).encode()).hexdigest()
    assert {(f.leaf, f.part): (f.rows, f.digest) for f in files} == {k: (len(own), ids(own)) for k, own in want.items()}
    for f in files:
        assert sorted(map(repr, pq.ParquetFile(f.path).read().to_pylist())) == sorted(repr(dict(zip([c.split()[0] for c in KIND.split(", ")], r))) for r in want[(f.leaf, f.part)])


@pytest.mark.parametrize(("rows_of", "bytes_of"), [(3, 64 << 20), (262144, 300)])
def test_files_of_several_buckets(spark, monkeypatch, rows_of, bytes_of):
    """Files cut into buckets at hours and, in crowded hours within and above the limit, at row numbers."""
    monkeypatch.setattr(tp, "BUCKET_ROWS", rows_of)
    monkeypatch.setattr(tp, "BUCKET_BYTES", bytes_of)
    laid_out(spark, made(), 40)
