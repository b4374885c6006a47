import io
import json
import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException

from tests.captures import ENCODINGS, SECRETS, capture, entry
from wirelens import operators as ops
from wirelens.operators.detectors import DECLARED, EXTENSIONS
from wirelens.plans.analyse import analyse, compare_runs, records
from wirelens.sources import har, history
from wirelens.sources.har import address, instant, rows


def load(spark, folder, label="c"):
    return spark.read.format("har").option("capture_id", label).load(str(folder))


def counts(data: bytes) -> tuple[int, int, str]:
    found = list(rows(io.BytesIO(data), "c"))
    return sum(r[1] == "entry" for r in found), sum(r[1] == "page" for r in found), found[-1][3]


@pytest.fixture(params=["large buffer", "small buffer"])
def buffers(request, monkeypatch):
    """With a small buffer every value is walked through piece by piece."""
    if request.param == "small buffer":
        monkeypatch.setattr(har, "CHUNK", 7)
        monkeypatch.setattr(har, "MOST_HELD", 16)
        monkeypatch.setattr(har, "LONGEST_NUMBER", 20)


@pytest.mark.parametrize("encode", ENCODINGS)
@pytest.mark.parametrize("pages_last", [False, True])
@pytest.mark.usefixtures("buffers")
def test_every_cut_keeps_the_entries_before_it(encode, pages_last):
    data = encode(capture(4, pages_last)).encode()
    text = data.decode()
    decoder = json.JSONDecoder()
    # Ends of the real entries, by decoding from the array's bracket.
    ends, k = [], None
    for m in re.finditer(r'"entries":\s*\[\s*\{', text):
        try:
            k, ends = m.end() - 1, []
            while True:
                _, k = decoder.raw_decode(text, k)
                ends.append(len(text[:k].encode()))
                m2 = re.match(r"\s*,\s*", text[k:])
                if not m2:
                    break
                k += m2.end()
            if len(ends) == 4:
                break
        except ValueError:
            continue
    assert len(ends) == 4
    opened = len(text[: text.index("{", text.index('"log"')) + 1].encode())
    whole = len(text.rstrip().encode())
    for cut in range(len(data) + 1):
        n, _, status = counts(data[:cut])
        assert n == sum(e <= cut for e in ends), cut
        assert status == ("unreadable" if cut < opened else "complete" if cut >= whole else "truncated"), cut


@pytest.mark.parametrize("data", [b"", b"not json", b"[]", b"{}", b'{"log": 3}', b"\xff\xfe\x00", b'{"a": {"log": {}}}'])
@pytest.mark.usefixtures("buffers")
def test_what_is_no_capture_is_unreadable(data):
    assert counts(data) == (0, 0, "unreadable")


@pytest.mark.usefixtures("buffers")
def test_empty_log_and_byte_mark():
    assert counts(b'\xef\xbb\xbf{"log": {}}') == (0, 0, "complete")
    assert counts(b'{"log": {"entries": [], "pages": []}, "x": 1}') == (0, 0, "complete")
    assert counts(b'{"log": {"entries": [7, null, {}]}}') == (3, 0, "complete")


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=8), x, max_size=4), max_leaves=12))
def test_wrong_types_never_raise(value):
    made = json.dumps({"log": {"version": value, "pages": [value], "entries": [value, entry(1, request=value), entry(2, time=value, response=value, timings=value)]}})
    assert counts(made.encode("utf-8", "surrogatepass"))[0] == 3


def test_instants_and_addresses():
    assert instant("2024-01-02T03:04:05.123456789+02:00") == "2024-01-02T03:04:05.123456+02:00"
    assert instant("2024-01-02T03:04:05Z") == "2024-01-02T03:04:05.000000Z"
    assert instant("yesterday S3CRET") is None and instant(5) is None
    for url in ("data:text/plain,S3CRET", "blob:https://a/b", "http://[bad", "nonsense", 7, None):
        assert address(url) == (None, None)
    assert address("https://u:p@A.Example.com:1/x/12/y?z=1#q") == ("a.example.com", "/x/{n}/y")
    assert address("https://a.b/" + "k" * 60)[1] == "/{s}"


def test_normalised_values(spark, tmp_path):
    (tmp_path / "a.har").write_text(ENCODINGS[0](capture(3)), encoding="utf-8")
    captures, entries, pages = ops.normalise(load(spark, tmp_path))
    assert captures.collect() == [("c", "1.2", 3, 1, "complete")]
    e = entries.orderBy("entry_ix").collect()[0]
    assert e.started == datetime(2024, 3, 1, 8, 0, 0, 123456) or e.started.timestamp() == 1709280000.123456
    assert (e.request_body_bytes, e.response_body_bytes, e.content_bytes, e.page_ix) == (None, 500, 1000, 0)
    assert e.duration.total_seconds() == 0.1 and e.phases.blocked is None and e.phases.dns.microseconds == 1500
    p = pages.collect()[0]
    assert p.on_load is None and p.on_content_load.microseconds == 120500


def test_pages_behind_the_cut_leave_entries_without_page(spark, tmp_path):
    text = ENCODINGS[0](capture(3, pages_last=True))
    (tmp_path / "a.har").write_text(text[: text.rindex('"pages"') + 9], encoding="utf-8")
    captures, entries, _ = ops.normalise(load(spark, tmp_path))
    assert captures.first().parse_status == "truncated" and [r.page_ix for r in entries.collect()] == [None] * 3


def test_no_planted_secret_leaves_the_source(spark, tmp_path):
    wrong = capture(2)
    wrong["log"]["entries"][0]["time"] = "S3CRET-BODY"
    wrong["log"]["entries"][1]["request"]["method"] = "S3CRET-METHOD"
    wrong["log"]["version"] = "S3CRET-VERSION"
    texts = [ENCODINGS[0](capture(3)), ENCODINGS[0](capture(3))[:-400], ENCODINGS[2](wrong), "S3CRET-BODY"]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, t in enumerate(texts):
        (folder / f"S3CRET-USER-{i}.har").write_text(t, encoding="utf-8")
    done = analyse(spark, str(folder), "run", DECLARED + EXTENSIONS)
    out = str(tmp_path / "history")
    history.append(records(done, "lab"), out)
    told = [str(done.entries.collect()), str(done.pages.collect()), str(done.captures.collect()), str(done.findings.collect()), done.entries._jdf.queryExecution().toString() if hasattr(done.entries, "_jdf") else ""]
    told += [p.read_bytes().decode("latin-1") for p in (tmp_path / "history").rglob("*.parquet")]
    for secret in SECRETS:
        assert not any(secret in t for t in told), secret
    kept = history.read(spark, out)
    assert "host1" not in str(kept.collect()).lower() and kept.count() == 4
    with pytest.raises(ValueError):
        history.append(kept.withColumn("host", kept.run_id), out)


def test_history_and_comparison(spark, tmp_path):
    for name, n in (("a", 3), ("b", 4)):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "x.har").write_text(ENCODINGS[1](capture(n)), encoding="utf-8")
        history.append(records(analyse(spark, str(folder), name), "lab"), str(tmp_path / "h"))
    got = {(r.kind, r.metric): r for r in compare_runs(spark, str(tmp_path / "h"), "a", "b").collect()}
    assert got["count", "requests.requests"].delta_count == 1 and {r.status for r in got.values()} == {"ok"}
    assert compare_runs(spark, str(tmp_path / "h"), "a", "nowhere").first().status == "refused"


def test_counts_and_durations_do_not_mix(spark):
    df = spark.sql("SELECT INTERVAL '1' SECOND AS d, 2L AS n")
    for bad in ("d + n", "greatest(d, n)", "d > n", "CASE WHEN n = 1 THEN d ELSE n END"):
        with pytest.raises(AnalysisException):
            df.selectExpr(bad).collect()


def test_patterns_and_several_paths(spark, tmp_path):
    for name, n in (("a/x.har", 1), ("a/y.har", 2), ("b/z.har", 3), ("b/note.txt", 4)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(ENCODINGS[0](capture(n)), encoding="utf-8")
    sizes = lambda *paths: sorted(r.n_entries for r in ops.normalise(spark.read.format("har").option("capture_id", "c").load(*paths))[0].collect())
    assert sizes(f"{tmp_path}/a/*.har") == sizes(f"{tmp_path}/a") == [1, 2]
    assert sizes(f"{tmp_path}/*/*.har") == [1, 2, 3]
    assert sizes(f"file://{tmp_path}/[b]/z.har") == [3]
    assert sizes([f"{tmp_path}/a/y.har", f"{tmp_path}/b/*.har"]) == [2, 3]
    with pytest.raises(Exception, match="no capture"):
        sizes(f"{tmp_path}/*.json")


def test_values_of_any_size_pass_a_small_buffer(monkeypatch):
    """Bodies far larger than the buffer, in an entry, as a key, as a number and nested, give the same rows as a buffer that holds all."""
    big = "x\\\"é漢\n" * 3000
    made = [entry(1), entry(2, response={"status": 201, "content": {"text": big, "size": 7, "mimeType": "text/css"}, big: [big, {"a": [1.5e3, None, True]}], "bodySize": 9}), entry(3, comment=[[[big]]] * 3), entry(4, pageref=big), entry(5)]
    data = json.dumps({"log": {"creator": {"note": big}, "pages": [{"id": "p1", "title": big}], "entries": made}, "z": [big]}).encode()
    want = list(rows(io.BytesIO(data), "c"))
    assert want[-1][3] == "complete" and len(want) == 7 and want[2][-5] is not None
    for chunk, held in ((1 << 10, 1 << 11), (61, 100)):
        monkeypatch.setattr(har, "CHUNK", chunk)
        monkeypatch.setattr(har, "MOST_HELD", held)
        assert list(rows(io.BytesIO(data), "c")) == want
        for bad in (data.replace(b'"z"', b'"z" 1'), data.replace(b"1500.0", b"15.0.0"), data.replace(b"true", b"trux")):
            found = list(rows(io.BytesIO(bad), "c"))
            assert found[-1][3] == "truncated" and found[:-1] == want[: len(found) - 1]


class Endless(io.RawIOBase):
    """A capture of one entry with a huge body, then many small ones, made while it is read."""

    def __init__(self, body: int, n: int) -> None:
        small = json.dumps(entry(1)).encode()
        self.parts = [b'{"log": {"version": "1.2", "entries": [{"time": 5, "response": {"content": {"text": "', *[b"y" * 65536] * (body >> 16), b'", "size": 3}}}']
        self.parts += [b"," + small] * n + [b"]}}"]
        self.rest = b""

    def read(self, n: int = -1) -> bytes:
        while len(self.rest) < n and self.parts:
            self.rest += self.parts.pop(0)
        out, self.rest = self.rest[:n], self.rest[n:]
        return out


def test_memory_does_not_grow_with_the_capture():
    import tracemalloc

    def peak(body: int, n: int) -> int:
        source = Endless(body, n)
        tracemalloc.start()
        count = sum(1 for _ in rows(source, "c"))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert count == n + 2
        return most

    small, large = peak(1 << 22, 200), peak(1 << 27, 2000)
    assert large < small * 1.2 and large < 16 << 20


def opened(monkeypatch) -> list[str]:
    """Files that a reader in this process opens."""
    names, system = [], har._system

    class Watched:
        def __init__(self, of, path):
            self.of, self.path = of, path

        def __getattr__(self, name):
            return getattr(self.of, name)

        def open_input_stream(self, path):
            names.append(path)
            return self.of.open_input_stream(path)

    def watch(path):
        of, inner = system(path)
        return Watched(of, inner), inner

    monkeypatch.setattr(har, "_system", watch)
    return names


def test_filters_are_applied_before_files_are_opened(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    for k in range(4):
        (tmp_path / f"{k}.har").write_text(ENCODINGS[0](capture(k + 1)), encoding="utf-8")
    load = lambda push: spark.read.format("har").option("capture_id", "c").option("pushdown", push).load(str(tmp_path))
    for condition in ("capture_id = 'c-000002'", "capture_id IN ('c-000001', 'c-000003') AND kind = 'entry'", "kind = 'page'", "kind IN ('page', 'capture') AND ix = 0", "kind = 'nothing'", "capture_id = 'elsewhere'", "capture_id IS NULL", "kind = 'entry' AND status > 100"):
        # What the source applies is no longer in Spark's own filter.
        told = lambda push: re.search(r"^\W*(?:\(\d+\) )?Filter ", load(push).where(condition)._jdf.queryExecution().executedPlan().toString(), re.M)  # noqa: B023, E731
        assert bool(told("true")) == ("ix" in condition or "status" in condition or "NULL" in condition) and told("false")
        assert sorted(map(str, load("true").where(condition).collect())) == sorted(map(str, load("false").where(condition).collect())), condition

    names = opened(monkeypatch)
    reader = har.HarReader({"path": str(tmp_path), "capture_id": "c", "pushdown": "true"})
    rest = [GreaterThan(("ix",), 0)]
    assert list(reader.pushFilters([In(("capture_id",), ("c-000001", "c-000002")), EqualTo(("kind",), "page"), *rest])) == rest
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[:2] for r in got] == [("c-000001", "page"), ("c-000002", "page")] and len(names) == 2


def test_one_load_filtered_in_two_ways(spark, tmp_path):
    """Without the option nothing is pushed, as Spark would mix the filters of one DataFrame's branches; loaded twice, each has its own."""
    (tmp_path / "a.har").write_text(ENCODINGS[0](capture(3)), encoding="utf-8")
    raw = load(spark, tmp_path)
    both = raw.where("kind = 'entry'").select("ix").union(raw.where("kind = 'page'").select("ix"))
    assert both.count() == 4
    push = lambda: spark.read.format("har").option("pushdown", "true").option("capture_id", "c").load(str(tmp_path))
    assert [sorted(map(str, x.collect())) for x in ops.normalise(push)] == [sorted(map(str, x.collect())) for x in ops.normalise(raw)]


def take_all(spark, folder, where, log="log"):
    """Run a stream of captures until nothing is left, into a Parquet folder; its checkpoint and log last between runs."""
    stream = spark.readStream.format("har").option("capture_id", "c").option("log", f"{where}/{log}").load(str(folder))
    done = stream.writeStream.format("parquet").option("checkpointLocation", f"{where}/checkpoint").option("path", f"{where}/out").trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert done.exception() is None


def test_a_stream_takes_each_capture_once(spark, tmp_path):
    folder, where = tmp_path / "in", tmp_path / "state"
    folder.mkdir()
    where.mkdir()
    put = lambda k: (folder / f"{k}.har").write_text(ENCODINGS[0](capture(k + 1)), encoding="utf-8")
    taken = lambda: spark.read.parquet(f"{where}/out")
    put(0), put(1)
    take_all(spark, folder, where)
    assert taken().where("kind = 'capture'").count() == 2
    take_all(spark, folder, where)  # restarted with nothing new
    put(2)
    # A batch that was named in the log, but not done when the stream died, is taken when it starts again.
    reader = har.HarStreamReader({"path": str(folder), "capture_id": "c", "log": f"{where}/log"})
    assert reader.latestOffset() == {"captures": 3}
    put(3)
    take_all(spark, folder, where)
    got = taken().select(*load(spark, folder).columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, load(spark, folder).collect()))


def test_small_captures_share_a_task(spark, tmp_path, monkeypatch):
    for k in range(30):
        (tmp_path / f"{k:02d}.har").write_text(ENCODINGS[0](capture(k % 4 + 1)), encoding="utf-8")
    reader = har.HarReader({"path": str(tmp_path), "capture_id": "c"})
    (one,) = reader.partitions()
    whole = list(reader.read(one))
    assert [r[0] for r in whole if r[1] == "capture"] == [f"c-{k:06d}" for k in range(30)]
    assert load(spark, tmp_path).rdd.getNumPartitions() == 1
    most = (tmp_path / "03.har").stat().st_size  # the largest has a task of its own
    monkeypatch.setattr(har, "TOGETHER", most)
    parts = reader.partitions()
    assert 8 <= len(parts) < 30 and all(sum((tmp_path / uri[-6:]).stat().st_size for uri, _ in p.captures) <= most for p in parts)
    assert [r for p in parts for r in reader.read(p)] == whole


def test_queries_parse_each_capture_once(spark):
    from wirelens.plans import queries

    for part in queries._parsed(spark, "/root/testdata/sf0.001", False):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "parquet" in plan.lower() and "BatchScan" not in plan and "har" not in re.findall(r"Scan (\w+)", plan)
