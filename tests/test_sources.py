"""File sources and sinks."""
import json
import tempfile

from pagemark.sources import files


def test_key_file_and_missing(spark):
    d = tempfile.mkdtemp(prefix="pm-keys-")
    with open(f"{d}/keys", "w") as f:
        f.write("k1\n k2 \n\n# old\n  # older\nk1\n")
    assert sorted(r.key for r in files.read_key_file(spark, f"{d}/keys").collect()) == ["k1", "k2"]
    assert files.read_key_file(spark, f"{d}/missing").count() == 0


def test_url_defaults_and_outcome_sink(spark):
    d = tempfile.mkdtemp(prefix="pm-urls-")
    with open(f"{d}/urls.json", "w") as f:
        f.write(json.dumps({"url": "https://a.example/"}) + "\n")
        f.write(json.dumps({"url": "https://b.example/", "wait_until": "load", "headless": False}) + "\n")
    got = {r.url: r for r in files.read_urls(spark, f"{d}/urls.json", "json").collect()}
    assert got["https://a.example/"].timeout_ms == 60000 and got["https://a.example/"].headless is True
    assert got["https://b.example/"].wait_until == "load" and got["https://b.example/"].headless is False
    out = spark.createDataFrame([("u1", "ok"), ("u2", "refused")], "url string, status string")
    files.write_outcomes(out, f"{d}/outcomes")
    back = spark.read.parquet(f"{d}/outcomes/status=refused")
    assert [r.url for r in back.collect()] == ["u2"]


def test_request_log_json(spark):
    d = tempfile.mkdtemp(prefix="pm-req-")
    with open(f"{d}/r.json", "w") as f:
        f.write(json.dumps({"id": 1, "ts": "2024-01-01T00:00:00Z", "scope_type": "http", "path": "/mcp",
                            "query_string": "key=a", "headers": [{"name": "Host", "value": "localhost"}],
                            "client_ip": "1.2.3.4"}) + "\n")
    r = files.read_requests(spark, f"{d}/r.json").collect()[0]
    assert r.headers[0].name == "Host" and r.client_ip == "1.2.3.4"


def test_captured_responses(spark, tmp_path):
    """Header names of any case and repeats; lines that are no capture are left out."""
    lines = [{"url": "http://a/", "status": 200, "headers": [{"name": "Content-TYPE ", "value": " text/html"}, {"name": "X", "value": "1"}, {"name": "x", "value": "2"}], "body": "b", "elapsed_ms": 5},
             {"url": "http://b/", "status": 301, "headers": [{"name": "Location", "value": "/1"}, {"name": "LOCATION", "value": "/2"}, {"name": None, "value": "z"}]},
             {"url": "http://c/", "error": "connect error"}, {"status": 200}]
    path = tmp_path / "r"
    path.mkdir()
    (path / "one.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n[1, 2]\n\n")
    got = {r.url: r for r in files.read_responses(spark, str(path)).collect()}
    assert sorted(got) == ["http://a/", "http://b/", "http://c/"]
    assert got["http://a/"].headers == {"content-type": "text/html", "x": "2"} and got["http://a/"].body == "b"
    assert got["http://b/"].headers == {"location": "/1"}
    assert got["http://c/"].headers is None and got["http://c/"].error == "connect error" and got["http://c/"].status is None


def test_written_captures_are_read(spark, tmp_path):
    rows = spark.createDataFrame([("u", 200, {"A": "1"}, "t", 3, None), ("v", None, None, None, None, "e")],
                                 "url string, status int, headers map<string,string>, body string, elapsed_ms long, error string")
    files.write_captured(rows, f"{tmp_path}/r")
    assert {r.url: r.headers for r in files.read_responses(spark, f"{tmp_path}/r").collect()} == {"u": {"a": "1"}, "v": None}
    caps = spark.createDataFrame([("u", 1, "<p>", None)], "url string, elapsed_ms long, html string, capture_mode string")
    files.write_captured(caps, f"{tmp_path}/c")
    assert [(r.capture_mode, r.html) for r in files.read_captures(spark, f"{tmp_path}/c").collect()] == [("headless", "<p>")]
