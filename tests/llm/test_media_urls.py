import hashlib
import io
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from echofold.llm.media import area_resize, decode_bmp, decode_image, decode_netpbm, encode_bmp, encode_pgm, media_features, npy_tile, text_media
from echofold.llm.url_filter import judge_urls


def test_netpbm_and_bmp_round_trip():
    image = np.random.default_rng(1).integers(0, 256, (7, 13)).astype(np.uint8)
    assert (decode_image(encode_pgm(image)) == image).all()
    assert (decode_image(encode_bmp(image)) == image).all()
    assert decode_netpbm(b"P2 # c\n2 1\n# d\n255\n3 4").tolist() == [[3, 4]]
    assert decode_netpbm(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    for bad in (b"", b"P5\n2 2\n255\n\x00", b"P7 1 1 255 ", b"P5 1 1 65535\n\x00\x00"):
        with pytest.raises(ValueError):
            decode_netpbm(bad)
    with pytest.raises(ValueError):
        decode_bmp(b"BM")


def test_area_resize_equals_fine_grid(monkeypatch):
    from echofold.llm import media

    image = np.random.default_rng(2).integers(0, 256, (6, 10)).astype(np.uint8)
    fine = np.kron(image, np.ones((4, 3)))
    want = fine.reshape(4, 6, 3, 10).mean(axis=(1, 3))
    assert np.allclose(area_resize(image, 4, 3), want)
    monkeypatch.setattr(media, "BLOCK", 20)
    assert np.allclose(area_resize(image, 4, 3), want)
    assert np.load(io.BytesIO(npy_tile(image, 5))).shape == (5, 5)


def as_bmp(image):
    """8 bits, grey palette, rows from top to bottom."""
    n = image.size
    head = b"BM" + struct.pack("<IHHI", 1078 + n, 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, image.shape[1], -image.shape[0], 1, 8, 0, n, 0, 0, 256, 0)
    return head + b"".join(bytes([k, k, k, 0]) for k in range(256)) + image.tobytes()


def means_by_brute_force(image, rows, columns):
    """Each target cell's mean, from the share of every sample that it covers."""

    def shares(n, cells):
        edges = [Fraction(n * k, cells) for k in range(cells + 1)]
        return np.array([[float(max(0, min(b, i + 1) - max(a, i))) for i in range(n)] for a, b in zip(edges, edges[1:])])

    down, across = shares(image.shape[0], rows), shares(image.shape[1], columns)
    return down @ image @ across.T / (image.shape[0] / rows * image.shape[1] / columns)


def hash_by_brute_force(image):
    small = np.round(means_by_brute_force(image, 8, 9), 6)
    return f"{int(''.join(str(int(a < b)) for row in small for a, b in zip(row, row[1:])), 2):016x}"


def test_media_with_clashing_columns(spark):
    media = spark.createDataFrame([(1, "x", "y", bytearray(encode_pgm(np.zeros((2, 2)))))], "doc_id long, feature string, `a b` string, media binary")
    (r,) = media_features(media).collect()
    assert (r["doc_id"], r["a b"], r["feature"], r["error"]) == (1, "y", "0" * 16, None)


def test_text_media_keeps_every_byte(docs, rows):
    out = text_media(docs).collect()
    want = Counter()
    for r in rows:
        data = (r[1] or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        stored = encode_pgm(image) if zlib.crc32(data) % 2 == 0 else as_bmp(image)
        want[(r[0], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in out) == want
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in out:
        image = np.frombuffer(texts[r.doc_id] + b"\0" * (r.payload_bytes - r.n_bytes), np.uint8).reshape(-1, 64)
        assert r.error is None and r.feature == hash_by_brute_force(image)
        tile = np.load(io.BytesIO(bytes(r.tile)))
        assert tile.dtype == np.uint8 and np.abs(tile - means_by_brute_force(image, 16, 16)).max() <= 0.5 + 1e-6
    assert {r.media_bytes - r.payload_bytes > 1000 for r in out} == {True, False}


def test_unreadable_media_has_a_reason(spark, no_docs):
    media = spark.createDataFrame([(1, None), (2, bytearray(b"junk")), (3, bytearray(encode_pgm(np.zeros((2, 2)))))], "id long, media binary")
    out = {r.id: r for r in media_features(media, tile=True).collect()}
    assert out[1].error and out[2].error and out[1].feature is None
    assert out[3].payload_bytes == 4 and np.load(io.BytesIO(bytes(out[3].tile))).shape == (16, 16)
    assert text_media(no_docs).count() == 0


def judged_by_brute_force(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = ("", "") if not m else (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2])
    best = None
    for verdict, rule in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")):
        of_host, _, of_path = rule.partition("/")
        if (host == of_host or host.endswith("." + of_host)) and path.startswith("/" + of_path) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


def walk_by_brute_force(pages, damping=0.85, steps=8):
    """trust and distrust in pages, by the definition, on plain dictionaries."""
    links, n, trust, distrust = Counter(), Counter(), Counter(), Counter()
    for _, url, html, *_ in pages:
        host, _, rule = judged_by_brute_force(url)
        n[host] += 1
        trust[host] += rule is not None and rule[0] == "allow"
        distrust[host] += rule is not None and rule[0] == "block"
        for to in re.findall(r'<a\s[^>]*href="[a-z]+://([^/?#"]+)', html or ""):
            links[host, to] += 1
    for host in list(n):
        if "." in host:
            links[host, host.split(".", 1)[1]] += 1
    links = {(a, b): c for (a, b), c in links.items() if a and b and a != b}
    out = Counter()
    for (a, _), c in links.items():
        out[a] += c
    weight = {(a, b): c / out[a] for (a, b), c in links.items()}
    into = Counter()
    for (_, b), w in weight.items():
        into[b] += w

    def walk(seeds, moves):
        now = dict(seeds)
        for _ in range(steps):
            nxt = Counter({h: s * (1 - damping) for h, s in seeds.items()})
            for (a, b), w in moves.items():
                nxt[b] += damping * w * now.get(a, 0)
            now = nxt
        total = sum(now.values())
        return {h: v * sum(seeds.values()) / total for h, v in now.items()} if total else {}

    return n, walk(trust, weight), walk(distrust, {(b, a): w / into[b] for (a, b), w in weight.items()})


def test_urls_equal_brute_force(spark):
    pages = [(i, f"https://a{i % 3}.example.net/{'en' if i % 4 else 'de'}/{i}", '<a href="http://good.example.org/x">', "h") for i in range(12)]
    pages += [(20 + i, f"http://Bad.Example.com/{'de' if i % 4 else 'es'}/{i}?q#f", '<a class="x" href="http://worse.test/a"> <a href="/rel">', "h") for i in range(8)]
    pages += [(40, "http://friend.test/x", '<a href="http://bad.example.com/de/">' * 3, "h"), (41, "http://good.example.org/fr/", None, "h"), (42, "http://good.example.org/es", "", "h")]
    pages += [(50, None, None, None), (51, "no scheme", "x", "h"), (52, "http://example.net", "", "h"), (53, "x://", "", "h"), (42, "http://good.example.org/es", "", "h")]
    out = judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string, host string")).collect()
    n, trust, distrust = walk_by_brute_force(pages)
    url = {p[0]: p[1] for p in pages}
    assert Counter(r.page_id for r in out) == Counter(p[0] for p in pages)
    for r in out:
        host, path, rule = judged_by_brute_force(url[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule[1] if rule else None)
        assert abs(r.trust - trust.get(host, 0)) < 1e-5 and abs(r.distrust - distrust.get(host, 0)) < 1e-5
        bad = distrust.get(host, 0) - trust.get(host, 0) > 0.25 * n[host]
        assert r.verdict == (rule[0] if rule else "block" if bad else "allow")
    verdicts = {r.page_id: r.verdict for r in out}
    assert verdicts[20] == "block" and verdicts[42] == "allow" and verdicts[40] == "block"


def test_no_pages(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_walks_go_on_until_they_settle(spark):
    """Hosts a and b link only to each other; the limit of the walk is a = 0.15 * 10 + 0.85 * b, b = 0.85 * a."""
    pages = [(i, f"http://a/{i}", '<a href="http://b/">') for i in range(10)] + [(10 + i, f"http://b/{i}", '<a href="http://a/">') for i in range(15)]
    out = judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules=(("block", "a/"),)).collect()
    a = 1.5 / (1 - 0.85**2)
    want = {"a": a * 10 / (1.85 * a), "b": 0.85 * a * 10 / (1.85 * a)}
    assert all(abs(r.distrust - want[r.host]) < 1e-5 and r.trust == 0 for r in out)
    assert {r.host: r.verdict for r in out} == {"a": "block", "b": "block"}
