"""Audio and image features, maps, the endpoint, the document library, sorted tables."""

import io
import json
import urllib.request
import wave

import numpy as np
import pytest

from korvid import engine as engine_module
from korvid.apps import passages, server
from korvid.engine import Engine
from korvid.functions import audio, images


def tone(hz, seconds=0.5, rate=22_050):
    t = np.arange(int(seconds * rate)) / rate
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes((np.sin(2 * np.pi * hz * t) * 20_000).astype("<i2").tobytes())
    return out.getvalue()


def test_mfcc(tmp_path):
    low, same, high = (audio.mfcc(tone(*x)) for x in ((440,), (440, 0.5, 44_100), (4000,)))
    assert low.shape[1] == 13 and low.shape[0] == 1 + 11025 // 512
    mean = lambda m: m[4:-4].mean(axis=0)
    assert np.linalg.norm(mean(low) - mean(high)) > 3 * np.linalg.norm(mean(low) - mean(same))
    (tmp_path / "a.wav").write_bytes(tone(440))
    assert np.isfinite(audio.extract_audio(str(tmp_path / "a.wav"))).all()
    assert np.isfinite(audio.mfcc(tone(440, 0.0))).all()


def test_pnm():
    grey = images.read_pnm(b"P5\n3 2\n255\n" + bytes(range(6)))
    assert grey.shape == (2, 3, 3) and grey[1, 2].tolist() == [5, 5, 5]
    assert images.resized(grey, 6).shape == (6, 6, 3)
    with pytest.raises(ValueError):
        images.read_pnm(b"P3\n1 1\n255\n0 0 0")


@pytest.fixture()
def shops(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "t"))
    e.execute("CREATE TABLE shops (id INT PRIMARY KEY, place POINT); INSERT INTO shops VALUES (1, POINT(0, 0)), (2, POINT(0, 1)), (3, POINT(5, 5))")
    return e


def test_map_payload(shops):
    got = shops.map_payload("SELECT id FROM shops WHERE DISTANCIA(place, POINT(0, 0)) <= 200000 AND WITHIN(place, POLYGON((-1,-1),(-1,9),(9,9),(9,-1))) ORDER BY DISTANCIA(place, POINT(0, 1))")
    assert got["ids"] == [2, 1] and got["points"][2] == (3, 5.0, 5.0) and got["view"]["lat1"] == 5.0
    assert [s["kind"] for s in got["shapes"]] == ["circle", "polygon", "centre"]


def test_endpoint(shops):
    httpd = server.serve(shops, port=0)
    try:

        def post(body, path="/sql"):
            request = urllib.request.Request(f"http://127.0.0.1:{httpd.server_port}{path}", data=json.dumps(body).encode(), method="POST")
            with urllib.request.urlopen(request, timeout=60) as r:
                return json.loads(r.read())

        assert post({"sql": "SELECT id, place FROM shops ORDER BY id LIMIT 1"})["rows"] == [[1, {"lat": 0.0, "lon": 0.0}]]
        assert "nope" in post({"sql": "BEGIN; SELECT nope FROM shops"})["error"] and not shops.in_transaction
        for bad, path in (({"x": 1}, "/sql"), ({"sql": ""}, "/other")):
            with pytest.raises(urllib.error.HTTPError):
                post(bad, path)
    finally:
        httpd.shutdown()


def test_library_takes_documents(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "t"))
    e.execute("CREATE TABLE documents (id INT PRIMARY KEY, title TEXT); CREATE TABLE passages (id INT PRIMARY KEY, document INT REFERENCES documents, nth INT, page INT, last_page INT, words INT, text TEXT)")
    assert passages.add_document(e, "it's", [(1, "one two " * 200), (2, "end.\nReferences\n[1] x")]) == 1
    assert passages.add_document(e, "b", [(1, "short")]) == 2
    with pytest.raises(ValueError):
        passages.add_document(e, "c", [(1, "  ")])
    assert e.execute("SELECT document, COUNT(*) AS n, SUM(words) AS w FROM passages GROUP BY document ORDER BY document").rows() == [(1, 1, 401), (2, 1, 1)]


def test_sorted_tables_are_compacted_and_hashed_ones_filtered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engine_module, "MOST_PARTS", 3)
    e = Engine(spark, str(tmp_path / "t"))
    e.execute("CREATE TABLE s (id INT PRIMARY KEY, v INT) USING SEQUENTIAL; CREATE INDEX h ON s (v) USING HASH")
    for i in (5, 1, 4, 2, 3):
        e.execute(f"INSERT INTO s VALUES ({i}, {i * i})")
    assert len(e.catalog.get("s").parts) <= 3
    assert e.execute("SELECT id FROM s WHERE v = 16 OR id BETWEEN 2 AND 3 ORDER BY id").rows() == [(2,), (3,), (4,)]
