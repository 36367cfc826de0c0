import hashlib
import random
import time
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, language, mixing, quality, secrets_scan
from tidemark.llm.html_extract import Page, extract, extract_pages, made_page, model
from tidemark.llm.text import crc_mod, pieces

from .conftest import prose

# Quality -------------------------------------------------------------------------------------------------------


def graded(n=600):
    rnd = random.Random(9)
    rows = []
    for k in range(n):
        good = " ".join(prose(k * 31 + j, rnd.randint(5, 14)).capitalize() + "." for j in range(rnd.randint(2, 9)))
        bad = rnd.choice((good.upper().replace(" ", "!! "), " | ".join(good.split()), ("same " * 80).strip(), re.sub(" ", "### ", good)))
        rows.append((k, bad if k % 4 == 0 else good, int(k % 4 != 0)))
    return rows


def test_quality_on_held_out_rows(spark):
    docs = spark.createDataFrame(graded(), "doc_id bigint, text string, label int")
    described = quality.describe(docs, "doc_id", "label")
    fitted = quality.learn(described.where("doc_id % 3 != 1"))
    got = quality.score(described.where("doc_id % 3 = 1"), fitted, "doc_id", "label").collect()
    assert np.mean([(r["score"] >= 0.5) == r["label"] for r in got]) > 0.97


def test_quality_sums_equal_plain_fit(spark):
    rows = graded(90)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label int").repartition(5)
    fitted = quality.learn(quality.describe(docs, "label"))
    col = pa.array([t for _, t, _ in rows])
    x = np.concatenate([quality.statistics(d, at) for _, _, d, at in pieces(col, 700)])
    y = np.array([r[2] for r in rows])
    assert np.allclose(fitted.mean, [x[y == c].mean(axis=0) for c in (0, 1)])
    own = np.cov(x[y == 1].T, bias=True)
    within = sum(np.cov(x[y == c].T, bias=True) * (y == c).sum() for c in (0, 1)) / len(y)
    want = (1 - fitted.pool - fitted.diagonal) * own + fitted.pool * within + fitted.diagonal * np.diag(np.diag(own))
    assert np.allclose(fitted.chol[1] @ fitted.chol[1].T, want, atol=1e-3)
    # What is chosen gives the labels of the half that a model hasn't seen the highest likelihood.
    known = quality.describe(docs, "label").select("label", F.pmod(F.xxhash64("x"), F.lit(2)).alias("half"), "x").collect()
    label, half, x = (np.array([r[k] for r in known]) for k in (0, 1, 2))
    losses = {}
    for choice in quality.CHOICES:
        for soften in quality.SOFTENINGS:
            for h in (0, 1):
                parts = [x[(half == h) & (label == c)] for c in (0, 1)]
                other = quality.Model(np.array([len(p) for p in parts], float), np.stack([p.sum(axis=0) for p in parts]), np.stack([p.T @ p for p in parts]), *choice, soften)
                p = np.clip(other.score(x[half != h]), 1e-15, 1 - 1e-15)
                losses[choice, soften] = losses.get((choice, soften), 0) - np.log(np.where(label[half != h] == 1, p, 1 - p)).sum()
    assert np.isclose(losses[(fitted.pool, fitted.diagonal), fitted.soften], min(losses.values()), rtol=1e-6)


def test_quality_awkward(spark, stored, none):
    described = quality.describe(stored, "doc_id")
    without = quality.learn(described.withColumn("label", F.lit(None).cast("int")))
    got = quality.score(described, without, "doc_id").collect()
    assert len(got) == stored.count() and {r["score"] for r in got} == {0.5}
    one = quality.learn(described.withColumn("label", F.lit(1)))
    assert {r["score"] for r in quality.score(described, one, "doc_id").collect()} == {1.0}
    assert quality.score(quality.describe(none, "doc_id"), one, "doc_id").collect() == []
    x = [r["x"] for r in described.collect()]
    assert np.isfinite(x).all()


# Language ------------------------------------------------------------------------------------------------------

WORDS = {"aa": "kala mano sita para lora vana", "bb": "strk blitz krmt gelb schnz tropf", "cc": "über größe für öde äste mühe"}


def spoken(lang, words, seed):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS[lang].split()) + rnd.choice(("", "s", "en")) for _ in range(words))


def test_language_on_held_out_rows(spark):
    rows = [(k, spoken(lang, 5 + k % 40, k), lang) for k in range(300) for lang in WORDS]
    rows = [(n, t, lang) for n, (_, t, lang) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    rest = crc_mod(F.col("doc_id"), 5)
    fitted = language.learn(docs, rest != 0, 100)
    got = language.identify(docs.where(rest == 0), fitted).collect()
    assert len(got) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.99
    assert all(0 <= r["lang_score"] <= 1 for r in got)
    # Words of switched text get the label of their stretch.
    text = " ".join((spoken("aa", 12, 1), spoken("cc", 12, 2), spoken("bb", 12, 3))).encode()
    marginal, _ = fitted.label(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    best = [fitted.languages[k] for k in marginal.argmax(axis=1)]
    assert sum(a == b for a, b in zip(best, ["aa"] * 12 + ["cc"] * 12 + ["bb"] * 12, strict=True)) >= 33


def test_forward_backward_equals_sum_over_paths():
    rng = np.random.default_rng(0)
    scores, move = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    length = np.array([4, 2])
    marginal, pairs, log_z, *_ = language.forward_backward(scores, length, move)
    want_pairs = np.zeros((3, 3))
    for c, n in enumerate(length):
        paths = [p for p in np.ndindex(*[3] * n)]
        weight = np.array([np.exp(sum(scores[c, t, p[t]] for t in range(n)) + sum(move[p[t - 1], p[t]] for t in range(1, n))) for p in paths])
        assert np.isclose(log_z[c], np.log(weight.sum()))
        weight /= weight.sum()
        for t in range(n):
            assert np.allclose(marginal[c, t], [sum(w for w, p in zip(weight, paths, strict=True) if p[t] == k) for k in range(3)])
            for w, p in zip(weight, paths, strict=True):
                if t:
                    want_pairs[p[t - 1], p[t]] += w
    assert np.allclose(pairs, want_pairs)


def test_blocks_of_a_text_are_one_chain(monkeypatch):
    rng = np.random.default_rng(4)
    weights = rng.normal(size=(language.FEATURES, 3)).astype(np.float32) / 8
    # Labels that hold on to each other, so that messages reach far.
    fitted = language.Model(["a", "b", "c"], weights, np.eye(3, dtype=np.float32) * 4)
    raw = [" ".join(f"w{x}" for x in rng.integers(0, 900, n)).replace("0", "o").translate(str.maketrans("123456789", "abcdefghi")).encode() for n in (40, 0, 1, 7, 8, 9, 23, 64)]
    data, at = np.frombuffer(b" ".join(raw), np.uint8), np.cumsum([0] + [len(r) + 1 for r in raw])
    at[-1] -= 1
    monkeypatch.setattr(language, "CHAIN", 10_000)
    whole = fitted.label(data, at)[0]
    monkeypatch.setattr(language, "CHAIN", 8)
    assert np.abs(fitted.label(data, at)[0] - whole).max() < 1e-4


def test_language_replaces_columns_of_its_names(spark):
    docs = spark.createDataFrame([(1, spoken("aa", 9, 1), "aa", "old", 2.0)], "doc_id bigint, text string, lang string, lang_pred string, Lang_Score double")
    got = language.identify(docs, language.learn(docs, F.lit(True)))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score"] and got.first()["lang_pred"] == "aa"


def test_emissions_equal_sums_word_by_word():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(language.FEATURES, 2)).astype(np.float32)
    raw = [t.encode() for t in ("Über Äste, ab c", "", "x12y", "naïve É " * 3)]
    together = language.emissions(language.Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])), weights)
    alone = [language.emissions(language.Words(np.frombuffer(r, np.uint8), np.array([0, len(r)])), weights) for r in raw]
    assert len(together) == sum(map(len, alone))
    assert np.allclose(together, np.concatenate(alone), atol=1e-4)


def test_language_awkward(spark, stored, none):
    rows = [(k, spoken(lang, 9, k), lang) for k, lang in enumerate(list(WORDS) * 30)]
    fitted = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    got = language.identify(stored, fitted, "text", "__l", "__s").collect()
    assert len(got) == stored.count()
    for r in got:
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (r["__l"] == "und") == (not letters) and (letters or r["__s"] == 0)
    assert language.identify(none, fitted, "text", "__l", "__s").collect() == []
    assert language.learn(none, F.lit(True)) is None
    assert {r["__l"] for r in language.identify(stored, None, "text", "__l", "__s").collect()} == {"und"}


# Secrets -------------------------------------------------------------------------------------------------------


def base_brute(text):
    s = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s))


def test_secrets_base_against_brute_force(spark):
    rnd = random.Random(6)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789ab", "x.y/z+1_2-3", "é", "\n", "word", "ſecret", "Kk"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 14))) for _ in range(700)] + [None, "", "token=abcdef", "a" * 24, "key " + "f" * 23]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in secrets_scan.secret_scan(docs).collect()}
    for k, t in enumerate(texts):
        want = base_brute(t or "")
        base = ",".join(s for s in got[k]["spans"].split(",") if not s.startswith("model"))
        assert base == want and got[k]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in ("assign", "access", "hex")] == [want.count(f"{x}:") for x in ("assign", "access", "hex")]


def test_secrets_network_on_other_findings():
    net = secrets_scan.network()
    made = secrets_scan.made_findings(1500, seed=1234)
    # Through candidates and patterns, by the threshold that is used.
    assert secrets_scan.recall_of(net, made) >= secrets_scan.RECALL - 0.01
    wrong = [any(k == "model" for _, _, k, _ in secrets_scan.scan_text(t, net)) for t, _, _, label in made if not label]
    assert np.mean(wrong) < 0.03
    found = secrets_scan.scan_text("deploy with ghp_a8Zk2Lq9Xw3Rt6Yu1Io5Pa7Sd0Fg4Hj2Kl9Z now", net)
    assert [(s[0], s[1], s[2]) for s in found] == [(12, 52, "model")]


def test_threshold_is_the_highest_that_keeps_the_recall():
    findings = [(t, a, b, int(rnd < 0.5)) for (t, a, b, _), rnd in zip(secrets_scan.made_findings(300, 3), np.random.default_rng(1).random(300), strict=True)]
    net = secrets_scan.train(findings, recall=0.9, epochs=1)
    held = [findings[k] for k in np.random.default_rng(5).permutation(300)[:60].tolist()]
    scores = np.sort([secrets_scan.scored(net, t, [(a, b)])[0] for t, a, b, label in held if label])
    assert (scores >= net.threshold).mean() >= 0.9 > (scores > net.threshold).mean() - 1e-9 or len(scores) < 10


def test_secrets_without_digits_beyond_patterns_and_in_long_candidates():
    net = secrets_scan.network()
    kinds = lambda t: [s[:3] for s in secrets_scan.scan_text(t, net)]
    key = "qZxWvKjPmRtYbHnLcDfGsQwX"
    assert kinds(f"use {key} here") == [(4, 28, "model")]
    inside = "sk_" + "0123456789abcdef01234567" + "XYZkQ9"
    assert kinds(f"key {inside} end") == [(4, 4 + len(inside), "model"), (7, 31, "hex")]
    # Random characters in the middle of a long candidate.
    long = "-" * 50 + "a8Zk2Lq9Xw3Rt6Yu1Io5Pa7Sd0Fg4Hj2Kl9ZQwErTy" + "-" * 50
    assert kinds(f"x {long} y") == [(2, 2 + len(long), "model")]
    assert kinds("password=abcdefgh12345678 x") == [(0, 25, "assign")]


def test_secrets_of_long_texts_take_time_in_proportion():
    net, times = secrets_scan.network(), []
    for n in (1, 8):
        began = time.perf_counter()
        secrets_scan.scan_text("password=abc123 " * (10_000 * n) + "a1" * (50_000 * n), net)
        times.append(time.perf_counter() - began)
    assert times[1] < 24 * times[0] + 0.5


def test_secrets_awkward(stored, none):
    assert secrets_scan.secret_scan(stored).count() == stored.count()
    assert secrets_scan.secret_scan(none).collect() == []


# Pages ---------------------------------------------------------------------------------------------------------


def test_pages_of_another_seed():
    rnd = random.Random(4242)
    made = [made_page(rnd) for _ in range(150)]
    got = extract([p for p, _ in made], model())
    assert np.mean([g == b for g, (_, b) in zip(got, made, strict=True)]) > 0.9
    right = sum(len(set(g) & set(b)) for g, (_, b) in zip(got, made, strict=True))
    assert right / sum(len(set(g)) for g in got) > 0.99 and right / sum(len(set(b)) for _, b in made) > 0.98


def test_page_parts_are_dropped_and_text_is_clean():
    body = "".join(f"<p>{prose(k, 40)}&amp;  x<br>y\n z&nbsp;</p>" for k in range(5))
    page = f"<html><head><title>T</title></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><!-- <p>no</p> --><article><h1>The &lt;title&gt;</h1>{body}<div class='ad'>Buy this now.</div></article><div class='comments'><p>Nice post.</p></div><form><input>Sign up</form><script>var a='<p>x</p>';</script><footer>&copy; me</footer>"
    assert extract([page], model())[0] == ["The <title>"] + [f"{prose(k, 40)}& x y z" for k in range(5)]


def test_decoding_is_consistent():
    rng = np.random.default_rng(2)
    rnd = random.Random(5)
    for _ in range(30):
        page = Page(made_page(rnd)[0])
        kept = page.decode(rng.random(len(page.tag)))
        assert all(p < 0 or kept[p] for p, k in zip(page.parent, kept, strict=True) if k)


def test_decoding_is_most_likely():
    page = Page("<div><p>a</p><div><p>b</p><p>c</p></div></div><p>d</p>")
    rng = np.random.default_rng(3)
    n = len(page.tag)
    for _ in range(40):
        p = rng.uniform(0.05, 0.95, n)
        best, top = None, -np.inf
        for bits in np.ndindex(*[2] * n):
            if bits[0] and all(bits[page.parent[k]] or not bits[k] for k in range(1, n)):
                value = sum(np.log(q) if b else np.log(1 - q) for b, q in zip(bits, p, strict=True))
                if value > top:
                    best, top = bits, value
        assert page.decode(p).tolist() == [bool(b) for b in best]


def test_awkward_pages(spark):
    pages = [(1, "u", None, "c"), (2, None, "", "c"), (None, "u", "<p>", "c"), (4, "u", "a < b &amp; c", "c"), (4, "u", "<div><div><div>" * 400 + "x", "c"), (5, "u", "<script>" + "x" * 10, "c"), (6, "u", "<a href='" + "<p>" * 50, "c"), (7, "u", "<!--", "c"), (8, "u", "</div></p></body>", "c")]
    got = extract_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string, text string")).collect()
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] in (1, 2, 5, 7, 8)} == {1: "", 2: "", 5: "", 7: "", 8: ""}
    assert extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


@pytest.mark.parametrize("hidden", ['<div style="display:none"><p>a<p>b</div>', "<div hidden><p>a<p>b</div>", "<template><p>x<ul><li>a</ul></template>", "<p hidden>x<div>d</div>", "<svg><p>q<p>r</svg>"])
def test_open_paragraphs_in_hidden_parts_hide_nothing_else(hidden):
    blocks = ["A title of some words"] + [f"This is sentence {k} of the story. It goes on for some words, as stories do." for k in range(6)]
    article = f"<article><h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:]) + "</article>"
    assert [b for b in extract([f"<html><body>{hidden}{article}</body></html>"], model())[0] if b != "d"] == blocks


#: Written by hand after common layouts, not by the recipe that the trees learn from: (html, blocks of the article).
HAND_MADE = [
    (
        """<html><head><title>Harbour news</title></head><body><div id="page"><div class="site-header"><a href="/"><img src="l.png"></a><ul class="menu"><li><a href="/n">News</a><li><a href="/s">Sport</a></ul></div>
        <div class="content-wrapper"><div class="entry-content"><h1>Harbour reopens after storm</h1><p>The harbour was opened again on Monday, after two weeks of repairs. Boats had been kept out since the storm.
        <p>"We are glad to be back," said a fisher. The town counts on the trade.<ul><li>Two piers were rebuilt.<li>One crane was lost.</ul></div>
        <div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Rain again</a><li><a href="/2">Local fair</a></ul></div></div><div class="footer">&copy; The Paper. All rights reserved.</div></div></body></html>""",
        ["Harbour reopens after storm", "The harbour was opened again on Monday, after two weeks of repairs. Boats had been kept out since the storm.", '"We are glad to be back," said a fisher. The town counts on the trade.', "Two piers were rebuilt.", "One crane was lost."],
    ),
    (
        """<!doctype html><html><body class="single"><nav><a href="/">Home</a> | <a href="/blog">Blog</a></nav><div class="cookie-consent"><p>We use cookies to improve this site.<button>Accept</button></div>
        <main><article><header><h1>On baking bread</h1></header><p>Bread needs flour, water, salt and time. Most of all it needs time, as the dough must rest.</p><blockquote><p>Bread is patience, baked.</p></blockquote>
        <p>Let the dough rest for a night. Then bake it hot, and let it cool before you cut it.</p></article><section class="comments"><h3>Comments</h3><div class="comment"><p>Great recipe, thanks!</p></div></section></main>
        <form class="newsletter"><p>Sign up for our letter</p><input></form><footer><p>Imprint</p></footer></body></html>""",
        ["On baking bread", "Bread needs flour, water, salt and time. Most of all it needs time, as the dough must rest.", "Bread is patience, baked.", "Let the dough rest for a night. Then bake it hot, and let it cool before you cut it."],
    ),
]


@pytest.mark.parametrize("page, blocks", HAND_MADE)
def test_pages_not_made_by_the_recipe(page, blocks):
    assert extract([page], model())[0] == blocks


def test_broken_tags_take_linear_time():
    began = time.perf_counter()
    for part in ('<a "', '<a ="', "<a ='\">", "<!", "</", "<blockquote>", "<p>a", "</ul><div>"):
        Page(part * (1_000_000 // len(part)) if part[0] + part[-1] != "<>" else part * 60_000)
    assert time.perf_counter() - began < 20


# Mixing --------------------------------------------------------------------------------------------------------


def rake_brute(cells, targets, rounds=3000):
    now = dict(cells)
    for _ in range(rounds):
        for m, target in enumerate(targets):
            have = {}
            for k, v in now.items():
                have[k[m]] = have.get(k[m], 0) + v
            now = {k: v * target[k[m]] / have[k[m]] if have[k[m]] else 0 for k, v in now.items()}
    return now


@pytest.mark.parametrize("cells_most", [1000, 0])
def test_mixing_against_plain_raking(spark, cells_most, tmp_path):
    rnd = random.Random(8)
    rows = [(k, prose(k, rnd.randint(0, 30)), rnd.choice(("a", "b", "b", "b", None)), rnd.choice(("x", "x", "y"))) for k in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    margins = {"source": 0.5, "lang": 0.0}
    got = mixing.mixture(docs, 0.4, margins, cells_most=cells_most).collect()
    mass = {}
    for r in got:
        mass[r["source"], r["lang"]] = mass.get((r["source"], r["lang"]), 0) + r["n_tokens"]
    total = sum(mass.values())
    targets = []
    for m, alpha in enumerate(margins.values()):
        own = {}
        for k, v in mass.items():
            own[k[m]] = own.get(k[m], 0) + v
        t = {k: v**alpha for k, v in own.items()}
        targets.append({k: v * total / sum(t.values()) for k, v in t.items()})
    want = rake_brute(mass, targets)
    for r in got:
        assert np.isclose(r["weight"], want[r["source"], r["lang"]] / mass[r["source"], r["lang"]], rtol=1e-6)
        assert 0 <= r["prob"] <= 1
    assert np.isclose(sum(r["prob"] * r["n_tokens"] for r in got), 0.4 * total, rtol=1e-6)
    assert abs(sum(r["n_tokens"] for r in got if r["sampled"]) / total - 0.4) < 0.12


def test_calibration_with_capped_probabilities():
    weight, mass = np.array([10.0, 1.0, 0.1, 0.0]), np.array([5, 50, 100, 7])
    for keep in (0.01, 0.2, 0.5, 0.9):
        f = mixing.calibrate(weight, mass, keep)
        assert np.isclose((mass * np.minimum(1, f * weight)).sum(), keep * mass.sum())
    assert np.minimum(1, mixing.calibrate(weight, mass, 1.0) * weight).tolist() == [1, 1, 1, 0]


def test_mixing_awkward(stored, none):
    got = mixing.mixture(stored, 0.5).collect()
    assert len(got) == stored.count()
    assert mixing.mixture(none, 0.5).collect() == []


# Chat ----------------------------------------------------------------------------------------------------------


def talk(n=120, seed=3):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        order = ["system"] * (c % 4 == 0) + ["user", "assistant"] * rnd.randint(1, 4)
        for t, role in enumerate(order):
            text = {"system": "You are helpful and brief.", "user": f"What about {prose(c * 50 + t, 5)}?", "assistant": f"It is {prose(c * 70 + t, 25)}.\n- {prose(t, 3)}"}[role]
            rows.append((c, t, role, text))
    return rows


def test_chat_recovers_roles(spark):
    rows = talk()
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    fitted = chat.learn(frame, F.col("conv_id") % 3 != 0)
    got = chat.format_conversations(frame, fitted).collect()
    role = {(c, t): r for c, t, r, _ in rows}
    held = [r for r in got if r["conv_id"] % 3 == 0]
    assert np.mean([role[r["conv_id"], r["turn"]] == r["role"] for r in held]) > 0.97
    assert len(got) == len(rows) and all(r["rendered"] == f"<|{r['role']}|>\n{r['text']}\n<|end|>\n" for r in got)


def test_chat_stretches_equal_viterbi(spark):
    """One conversation over many tasks gets the states of the plain algorithm."""
    rows = [(7, k, None, text) for k, (_, _, _, text) in enumerate(talk(40, 8))]
    fitted = chat.fit([((c,), r, t) for c, _, r, t in talk(60, 1)])
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    got = sorted(chat.format_conversations(frame, fitted).collect(), key=lambda r: (r["turn"], r["piece"]))
    values, lines, begins = chat._lines([r[3] for r in rows])
    want = chat.turns(fitted.decode(values, None, None), lines, fitted.roles, begins)
    assert [(r["turn"], r["role"], r["text"]) for r in got] == want


def test_chat_viterbi_is_the_best_path():
    fitted = chat.fit([])
    values, _, _ = chat._lines(["User: a?", "b", "hello.\nc"])
    e = fitted.emissions(values)
    n = len(fitted.start)
    score = lambda p: fitted.start[p[0]] + e[0, p[0]] + sum(fitted.move[p[t - 1], p[t]] + e[t, p[t]] for t in range(1, len(e)))
    assert np.isclose(score(fitted.decode(values, None, None)), max(score(p) for p in np.ndindex(*[n] * len(e))))


def test_chat_markers():
    fitted = chat.fit([])
    text = "System: be nice\nUser: hi there?\nmore\nAssistant: hello\n- a\n- b\nHuman: bye"
    assert chat.parse_transcript(text, fitted) == [("system", "be nice"), ("user", "hi there?\nmore"), ("assistant", "hello\n- a\n- b"), ("user", "bye")]
    assert chat.parse_transcript(None, fitted)[0][1] == ""


def test_chat_awkward(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (1, None, "user", ""), (1, 1, None, "a\n\n"), (1, 1, None, "a\n\n"), (2, 0, "user", "Hi " * 20_000)]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string")
    fitted = chat.learn(frame, F.lit(True))
    assert chat.format_conversations(frame, fitted).count() == len(rows)
    assert chat.format_conversations(frame.limit(0), chat.learn(frame.limit(0), F.lit(True))).collect() == []
