"""Chroma fingerprints, URL rules and page differencing."""

import io
import random
import re
import wave

import numpy as np
import pytest

from barflow.llm import chroma, page_diff, url_rules

SETTINGS = chroma.Settings(rate=8000, frame=2048, hop=400, low=100.0, high=2000.0)


def melody(seed, notes=80):
    rng = np.random.default_rng(seed)
    pitch = 110.0 * 2 ** (rng.integers(0, 48, notes) / 12)
    return 0.5 * np.sin(np.cumsum(np.repeat(2 * np.pi * pitch / 8000, 400)))


def test_integral_sums_equal_plain_sums():
    rng = np.random.default_rng(1)
    image = rng.random((30, 12))
    integral = np.zeros((31, 25))
    integral[1:, 1:] = np.concatenate([image, image], axis=1).cumsum(axis=0).cumsum(axis=1)
    got = chroma._sums(integral, np.arange(10), (2, 7), (1, 6), 9)
    assert np.allclose(got, [image[f + 2 : f + 7][:, [x % 12 for x in range(10, 15)]].sum() for f in range(10)])


def test_a_tone_has_its_pitch_class():
    for steps in range(12):
        tone = np.sin(2 * np.pi * 440 * 2 ** (steps / 12) * np.arange(16000) / 8000)
        assert (chroma.chroma(tone, 8000, SETTINGS).argmax(axis=1) == steps).all()


def test_wav_forms():
    x = melody(1, 5)
    assert np.allclose(chroma.read_wav(chroma.write_wav(x, 8000))[0], x, atol=1e-3)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(np.repeat((x * 127 + 128).astype("u1"), 2).tobytes())
    assert np.allclose(chroma.read_wav(out.getvalue())[0], x, atol=0.02)
    for bad in (None, b"", b"RIFF", chroma.write_wav(x, 8000)[:30]):
        assert len(chroma.read_wav(bad)[0]) == 0


def test_recordings_align(spark):
    rng = np.random.default_rng(0)
    base = melody(7)
    tracks = {
        1: base, 2: base, 3: np.concatenate([melody(8, 20), base]), 4: np.clip(base * 0.5 + rng.normal(0, 0.01, len(base)), -1, 1), 5: melody(9), 6: base[400 * 10 :],
        7: np.zeros(20000), 8: np.zeros(10),
    }
    rows = [(i, chroma.write_wav(x, 8000), "x") for i, x in tracks.items()] + [(9, None, "x"), (9, None, "x"), (10, b"no wav", "x")]
    prints = chroma.fingerprints(spark.createDataFrame(rows, "id long, audio binary, ints string"), "id", settings=SETTINGS)
    classes, links = chroma.align(prints, spark.createDataFrame([(2,), (7,), (99,)], "id long"), "id")
    got = [(r["id"], r["class_id"]) for r in classes.collect()]
    assert len(got) == len(rows) and dict(got)[2] == 1 and dict(got)[5] == 5 and {dict(got)[i] for i in (7, 8, 9, 10)} == {None}
    found = {r["found"]: (r["offset"], r["errors"]) for r in links.collect()}
    assert {i: o for i, (o, _) in found.items()} == {3: 20, 4: 0, 6: -10}
    assert all(e <= 0.15 for _, e in found.values())
    none, no_links = chroma.align(prints.limit(0), prints.limit(0).select("id"), "id")
    assert none.count() == 0 and no_links.count() == 0


URLS = [
    None, "", "no url", "http://EXAMPLE.com/en/7x?q#f", "https://a.example.com/en/8", "https://notexample.com/en/7", "x://com/en/", "http://com", "://org/es/a", "http://a.net/DE/", "http://a.net/de/",
    "http://example.net/de/8#a", "http://example.net/de/8\nx", "http://casino.org/", "http://a.org/x/casino-win?casino", "http://casinos.org/", "http://a.com:80/en/", "http://a/b://net/de/", "http://é.com/en/ü",
]
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "allow"), ("org", "/es/", "block")]


def test_url_rules_against_brute_force(spark):
    words = ["casino", "win"]
    rules = [url_rules.path_rule(*r) for r in RULES] + [url_rules.word_rule(w) for w in words]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[3], "x"), (4, URLS[4], "x")], "page_id long, url string, token string")
    rows = url_rules.apply_rules(pages, url_rules.rule_table(spark, rules), ["page_id"]).collect()
    assert len(rows) == len(URLS) + 2
    got = {r["page_id"]: r for r in rows if r["page_id"] is not None}
    for i, u in enumerate(URLS):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :], re.S)[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if ("." + host).endswith("." + h) and path.startswith(p)]
        if fits:
            want = max(fits)[1:]
        else:
            hit = [w for w in words if re.search(f"(^|[^a-z0-9]){w}($|[^a-z0-9])", f"{host}\n{path}", re.I)]
            want = (max(hit, key=lambda w: (len(w), w)), "block") if hit else None
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert (got[i]["hit"] and (got[i]["hit"]["rule"], got[i]["hit"]["verdict"])) == want, u


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"http://common{i % 2}.com/a") for i in range(9)] + [(10, "http://rare.com/a")], "page_id long, url string")
    plan = url_rules.apply_rules(pages, url_rules.rule_table(spark, [url_rules.path_rule("rare.com", "/a", "block")]), ["page_id"])
    assert [r["page_id"] for r in plan.where("hit is not null").collect()] == [10]
    with pytest.raises(Exception, match="no token"):
        url_rules.apply_rules(pages, url_rules.rule_table(spark, [url_rules.Rule("x", ".", (), "block", 1)]), ["page_id"]).collect()
    assert url_rules.apply_rules(pages.limit(0), url_rules.rule_table(spark, []), ["page_id"]).count() == 0


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in "ab")
        found = sorted(page_diff.shared_lines(a, b))
        rest = iter(b)
        assert len(found) == longest(a, b) and all(any(x == a[i] for x in rest) for i in found)


def test_blocks_respect_marks():
    page = (
        '<head><title>t</title></head><body><div class="sidebar">x<div>y</div></div><main>A <b>b</b>&nbsp;c<br>d<ul><li>1<li>2</ul><div id="comments"><p>no</div>z</main>'
        '<script>if (a<b) "</p>"</script><!-- <p>c</p> --><form>f</form>plain<footer>f</footer>'
    )
    assert page_diff.blocks(page) == [(1, "A b c d"), (1, "1"), (1, "2"), (1, "z"), (0, "plain")]
    for broken in ("", "<", "<p", "a<b", "</div></p>x", "<article><p>x", "&amp &lt;b&gt; &#x41;", "<div class='ad'>x", "<p>" * 3000):
        page_diff.blocks(broken)


def test_template_lines_of_neighbours_go(spark):
    def page(i, extra=""):
        return f"<body><div>Site name</div><div>text of page {i} {i * i}</div>{extra}<div>All rights reserved</div></body>"

    rows = [(i, f"http://a.org/p/{i:03d}", page(i), "x") for i in range(40)] + [(50, "http://b.org/1", page(50), "x"), (51, None, None, "x"), (52, "http://c.org/", "", "x")]
    rows += [(60, "http://d.org/a", "<article><p>Same</p></article><p>t", "x"), (61, "http://d.org/b", "<article><p>Same</p></article><p>t", "x"), (None, "http://b.org/1", page(50), "x")]
    got = page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), ["page_id", "url"]).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[i] == f"text of page {i} {i * i}" for i in range(40))
    assert text[50] == text[None] == "Site name\ntext of page 50 2500\nAll rights reserved"
    assert text[51] == text[52] == "" and text[60] == text[61] == "Same"
    assert page_diff.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
