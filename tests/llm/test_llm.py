"""The operators against brute force, and on odd rows."""

import base64
import random
import re
import zlib
from hashlib import sha256
from html import unescape

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keylode.llm import chunks, op1_minhash, op2_pii, op3_packing, op4_html, op5_chat, op6_toxicity, op7_substring, op8_vectors, op9_topk, op10_bpe, textvec
from keylode.llm.components import components
from keylode.llm.work import Work

tokenizers = pytest.importorskip("public_tokenizers")


def prose(r, n, pool=400):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(3)) + str(r.randrange(pool)) for _ in range(n))


def edited(r, text, share):
    return " ".join(w if r.random() > share else "zz" + str(r.randrange(9999)) for w in text.split(" "))


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text): copies, near copies of all degrees, shared passages, odd texts."""
    r = random.Random(5)
    base, passage = prose(r, 160), prose(r, 67)
    texts = [prose(r, r.choice((3, 30, 200))) for _ in range(40)]
    texts += [base] * 5 + [edited(r, base, r.choice((0.005, 0.01, 0.02, 0.03))) for _ in range(60)]
    texts += [f"{prose(r, 60)} {passage}\n{prose(r, 40)}" for _ in range(6)]
    texts += ["one common line of a dozen words that many documents share with others\n" + prose(r, 90) for _ in range(30)]
    texts += [None, "", "  \n", "a", "a b c d", "A  B\tc d", "x" * 5000, "la " * 3000, "é日本 " * 30]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    frame = spark.createDataFrame(corpus, "doc_id long, text string")
    clash = [F.lit(1).alias(c) for c in ("rep", "key", "band", "bands", "component", "a", "b", "score", "predicted", "start", "n")]
    return frame.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), *clash)


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingle_set(text):
    w = tokens(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(ids, links):
    low = {i: i for i in ids}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_words_and_slices(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice("aB \n\té日\x0bz") for _ in range(r.choice((0, 1, 5, 300)))) for _ in range(200)] + [None, "x" * 500]
    monkeypatch.setattr(textvec, "SLICE", 64)
    hashes, first, start, end = textvec.words(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        raw, want = (t or "").encode(), tokens(t)
        own = slice(first[i], first[i + 1])
        assert [raw[a:b].lower() for a, b in zip(start[own], end[own])] == want
        assert all(seen.setdefault(w, h) == h for w, h in zip(want, hashes[own].tolist()))
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    r = random.Random(2)
    links = {"path": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 50)], "random": [(r.randrange(80), r.randrange(80)) for _ in range(60)], "none": []}[shape]
    found = components(spark.createDataFrame(links, "a long, b long"), Work(spark, "t"))
    got = {r["node"]: r["component"] for r in found.collect()}
    nodes = {x for p in links if p[0] != p[1] for x in p}
    want = classes(nodes, [p for p in links if p[0] != p[1]])
    assert got == want


@pytest.mark.parametrize(("pairs_up_to", "block"), [(24, 256), (2, 8)])
def test_op1(spark, docs, corpus, monkeypatch, pairs_up_to, block):
    monkeypatch.setattr(op1_minhash, "PAIRS_UP_TO", pairs_up_to)
    monkeypatch.setattr(op1_minhash, "BLOCK", block)
    sets = {i: shingle_set(t) for i, t in corpus}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = classes(sets, links)
    got = {r["doc_id"]: r for r in op1_minhash.near_duplicates(docs).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_op1_long_documents_do_not_share_bands():
    sign = op1_minhash.MinHash()
    r = np.random.default_rng(5)
    bands = [sign(r.integers(0, 2**63, 70_000).astype(np.uint64) * np.uint64(2) + np.uint64(k & 1)) for k in range(12)]
    assert not any((bands[i] == bands[j]).any() for i in range(12) for j in range(i))
    one = r.integers(0, 2**63, 50_000).astype(np.uint64)
    two = np.concatenate([one[:43_000], r.integers(0, 2**63, 7_000).astype(np.uint64)])
    equal = (sign(one).view(np.uint16) == sign(two).view(np.uint16)).mean()
    assert 0.6 < equal < 0.9 and (sign(one) == sign(two)).any()


def test_op1_repeated_ids(spark):
    r = random.Random(15)
    a, b = prose(r, 80), prose(r, 80)
    rows = [(5, a), (5, b), (5, a), (6, min(a, b)), (7, max(a, b)), (None, a)]
    out = op1_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["component_id"], x["kept"]) for x in out if x["doc_id"]) == [(5, 5, True)] * 3 + [(6, 5, False), (7, 7, True)]
    assert [x["kept"] for x in out if x["doc_id"] is None] == [None]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, lo, hi in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if lo <= len(d) <= hi and (kind == "phone" or luhn(d)):
                out.append((kind, *m.span()))
    return out


def test_op2_base_spans():
    r = random.Random(3)
    parts = ["a@b.co", "@", "x.y", "4111 1111 1111 1111", "4111111111111112", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "+1 (555) 123-4567", "+", "é", " ", "\n", "-", "12", ".", "a@b", "日", "0001.2.3.255"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert op2_pii.base_spans(t) == plain_spans(t), t
    assert op2_pii.base_spans("a" * 200_000 + "@b.c") == [("email", 0, 200_004)]


def test_op2_model_and_redaction(spark):
    fitted = op2_pii.model()
    text = "call 555-123-4567 or write jo.doe [at] mail [dot] com, ref 2021-03-04, mail a@b.com"
    found = op2_pii.spans(text, op2_pii.base_spans(text), fitted)
    assert [k for k, _, _ in found] == ["email", "email", "phone"]
    assert op2_pii.redacted(text, found) == "call [PHONE] or write [EMAIL], ref 2021-03-04, mail [EMAIL]"
    texts, spans, labels = op2_pii._examples(99, 800)
    margin = fitted[0].margin(np.array([op2_pii._format(t, s) for t, s in zip(texts, spans)]))
    chosen = np.array([m >= fitted[1][s[0]] for m, s in zip(margin, spans)])
    labels = np.array(labels)
    assert labels[chosen].mean() > 0.95 and chosen[labels == 1].mean() > 0.8
    rows = spark.createDataFrame([(1, text, 3, "x"), (2, None, 0, "y"), (3, "", 0, None)], "doc_id long, text string, n_chars long, spans string")
    out = {r["doc_id"]: r for r in op2_pii.detect(rows).collect()}
    assert out[2]["spans"] == "" and out[2]["base_sha256"] == sha256(b"").hexdigest() and out[1]["n_email"] == 1
    kept = {r["doc_id"]: r for r in op2_pii.redact(rows).collect()}
    assert kept[2]["text"] is None and kept[1]["n_chars"] == len(kept[1]["text"]) and kept[1]["spans"] == "x"


def test_op3(spark, docs, corpus):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(op3_packing.tokenizer_path())
    long = spark.createDataFrame([(1000, prose(random.Random(1), 9000))], "doc_id long, text string")
    rows = op3_packing.packed(docs.select("doc_id", "text").union(long), op3_packing.tokenizer_path(), with_ids=True).toPandas()
    want = {i: [*model.encode(t or "", add_special_tokens=False).ids, 2] for i, t in [*corpus, *((r["doc_id"], r["text"]) for r in long.collect())]}
    for i, own in rows.sort_values("start").groupby("doc_id"):
        assert np.frombuffer(b"".join(own["ids"]), "<u4").tolist() == want[i]
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and (own["doc_tokens"] == len(want[i])).all()
    assert set(rows["doc_id"]) == set(want)
    assert all(zlib.crc32(x) == c for x, c in zip(rows["ids"], rows["ids_crc32"]))
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 4096


def test_op3_plan():
    r = np.random.default_rng(1)
    sizes = np.minimum(4095, 1 + r.lognormal(6, 1, 20_000)).astype(int)
    histogram = dict(zip(*(x.tolist() for x in np.unique(-(-sizes // 16), return_counts=True))))
    packer = op3_packing.Packer(op3_packing.plan(histogram), sizes.size, 3)
    pieces = packer.lot(sizes.tolist())
    used = {}
    for _, _, n, s, _ in pieces:
        used[s] = used.get(s, 0) + n
    assert sum(used.values()) == sizes.sum() and max(used.values()) <= 4096
    assert 1 - sizes.sum() / (4096 * len(used)) < 0.01
    a = np.abs(r.normal(size=(12, 30)))
    x = op3_packing.nnls(a, b := np.abs(r.normal(size=12)))
    g = a.T @ (b - a @ x)
    assert (x >= 0).all() and (g < 1e-6).all() and np.abs(g[x > 0]).max() < 1e-5


def test_op3_words_as_the_tokenizer_has_them(monkeypatch):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(op3_packing.tokenizer_path())
    r = random.Random(12)
    letters = [*"aAbBeéßÉ ñ.,!?'sdt019  \n\t\r\x0b\x1c\x1d\x85\xa0 日本語́🙂‍Σς#½Ⅷ٣<|>×÷", "'s", "<|endoftext|>", " the"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["dogs' a", "don't. X's! a<|ENDOFTEXT|>b", "é́ éÉ .K K ıİ ß.ẞ ×÷ a×. ", "\x1c a\x1d b", None, "", "Σας ΣΑΣ. a①.", "x. " * 5000]
    want = [[*model.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    for size, most in ((1 << 24, 10**6), (700, 50)):  # tables that fill up, slices of a few texts
        monkeypatch.setattr(chunks, "SLICE", size)
        found = chunks.Words(op3_packing.tokenizer_path(), most)(pa.array(texts), 2)
        assert [x.tolist() for _, sizes, ids in found for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


@pytest.mark.parametrize("parts", [1, 40])
def test_op3_padding_does_not_grow_with_tasks(spark, parts):
    r = random.Random(13)
    rows = [(i, n, bytes(2 * n)) for i, n in enumerate(1 + int(r.lognormvariate(6, 1)) for _ in range(1500))]
    encoded = spark.createDataFrame(rows, "doc_id long, doc_tokens long, ids binary").repartition(parts)
    pieces = op3_packing.together(Work(spark, "t").table(op3_packing.pack(encoded), "pieces")).toPandas()
    used = pieces.groupby("sequence_id")["length"].sum()
    total = sum(n for _, n, _ in rows)
    assert used.sum() == total and used.max() <= 4096 and 1 - total / (4096 * len(used)) < 0.02
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]


def test_op4():
    score = op4_html.weights()
    for parts in op4_html._labelled_pages(99, 200):
        own = "".join(x for x, label in parts if label)
        flat = re.sub("</?[ab](?: [^>]*)?>", "", own.replace("<br>", " "))
        want = [" ".join(unescape(t).split()) for t in re.split("<[^>]*>", flat)]
        assert op4_html.main_text("".join(x for x, _ in parts), score) == "\n".join(t for t in want if t)
    page = '<nav><a href="/">x y</a></nav><article><h1>T &amp; t</h1><p>One\n two<br>three<script>var a="</p>";</script></p><form><p>mail me</p></form><p>End&nbsp;.</p></article><footer>f</footer>'
    assert op4_html.main_text(page, score) == "T & t\nOne two three\nEnd ."
    for odd in ("", "<", "<p", "<!--", "</", "<script>", "<p>a", "a < b", "<a href='", '<a b="' * 50, "<div>" * 5000, "\0<p>"):
        op4_html.main_text(odd, score)


PAGE = '<html><body><div class="layout has-sidebar"><nav><a href="/">m</a></nav><article><h1>T t</h1><p>Some long first paragraph stays here with words.</p>{}<p>Last words of the article are here too.</p></article><footer>f f</footer></div></body></html>'


@pytest.mark.parametrize(
    ("part", "text"),
    [
        ('<p>Before text stays <a class="related-link">linked words</a> after text.</p>', "Before text stays linked words after text."),
        ('<div class="legal-analysis"><p>one two three</p></div>', "one two three"),
        ('<p id="side-effects">a b c d</p>', "a b c d"),
        ('<h2 id="social-history">x y</h2>', "x y"),
        ('<div class="entry-header"><h2>H h</h2></div>', "H h"),
        ('<header><p class="byline">By whom</p></header>', "By whom"),
        ('<section class="legal"><p>' + "word " * 40 + "</p></section>", ("word " * 40).strip()),
        ('<p>x <button>go</button>y <span hidden>zz</span>q</p>', "x y q"),
        ("<p>a<b>b</b>c <i class='ad'>d</i></p>", "abc d"),
        ('<div class="ad">buy now this</div>', None),
        ('<div class="notice">short note</div>', None),
        ('<div id="cookie-notice"><p>we use them all the time here</p></div>', None),
        ('<div class="site-nav top"><a>x</a></div>', None),
        ('<section id="comments"><p>' + "nice " * 60 + "</p></section>", None),
        ("<form><p>mail me now please</p></form><aside><p>" + "more " * 30 + "</p></aside>", None),
    ],
)
def test_op4_names_of_elements(part, text):
    want = ["T t", "Some long first paragraph stays here with words.", *([text] if text else []), "Last words of the article are here too."]
    assert op4_html.main_text(PAGE.format(part), op4_html.weights()) == "\n".join(want)


def test_op4_halves_around_an_advert():
    half = "<div><p>one half of the page is long enough here</p></div>"
    page = f"<body>{half * 4}<div class='ad'>{'buy ' * 300}</div>{half * 3}</body>"
    assert op4_html.main_text(page, op4_html.weights()).count("one half") == 7


def test_op4_region_against_brute_force():
    r = random.Random(14)
    for _ in range(300):
        scores = [r.choice((-3, -2, -1, -0.5, 0, 0.5, 1, 2, 3)) for _ in range(r.randrange(14))]
        sums = {(i, j): sum(scores[i : j + 1]) for i in range(len(scores)) for j in range(i, len(scores))}
        found, best = op4_html.best_region(scores), max(sums.values(), default=0)
        assert sums[found] == best if best > 0 else found is None


def test_op4_nested_pages_stay_small():
    import tracemalloc

    tracemalloc.start()
    for page in ("<div>" * 40_000 + "x y z", "<div>a b c" * 25_000, "<div>a" * 20_000 + "</b></div>" * 20_000, "<b hidden>x" * 20_000, "<div><article>x" * 15_000):
        op4_html.main_text(page, op4_html.weights())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_op4_rows(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>a b c d e</p></article>", "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    out = {r["page_id"]: r for r in op4_html.extract(rows).collect()}
    assert out[1]["text"] == "a b c d e" and out[1]["n_chars"] == 9 and out[2]["text"] == ""


def test_op5(spark):
    r = random.Random(4)
    convs = {}
    for i in range(60):
        convs[i] = [(r.choice(("user", "assistant", None)), r.choice(("hi", "yes", "", None, "no"))) for _ in range(r.randint(1, 150 if i % 20 == 0 else 4))]
    convs[60], convs[61] = convs[0][:70], list(convs[0])
    rows = [(c, t, *x, 1) for c, turns in convs.items() for t, x in enumerate(turns)] + [(None, 0, "user", "x", 1)]
    out = op5_chat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")).collect()
    kept = {c for c, a in convs.items() if not any((len(b) > len(a) and b[: len(a)] == a) or (b == a and d < c) for d, b in convs.items() if d != c)}
    assert {x["conv_id"] for x in out} == kept
    for c in kept:
        parts = sorted((x["part"], x["text"], x["n_turns"]) for x in out if x["conv_id"] == c)
        assert "".join(p[1] for p in parts) == "".join(f"<|im_start|>{a if a is not None else 'unknown'}\n{b or ''}<|im_end|>\n" for a, b in convs[c])
        assert [p[0] for p in parts] == list(range(len(parts))) and parts[0][2] == len(convs[c])


def test_op6(spark):
    r = random.Random(6)
    bad = ["idiotic", "scummy", "worthless"]
    rows, labels = [], []
    for i in range(700):
        toxic = r.random() < 0.2
        words = prose(r, r.randint(5, 120)).split()
        if toxic:
            words[r.randrange(len(words))] = r.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(700, None), (701, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = op6_toxicity.toxicity(docs, spark.createDataFrame(labels + labels[:5], "doc_id long, toxic int")).toPandas().set_index("doc_id")
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([out["predicted"][i] == labels[i][1] for i in held])
    assert right > 0.97 and out["score"].between(0, 1).all() and out["score"][700] == out["score"][701]
    assert {r["doc_id"] for r in docs.where(op6_toxicity.held_out()).collect()} >= set(held)
    none = op6_toxicity.toxicity(docs.limit(3), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [x["score"] for x in none.collect()] == [0, 0, 0]


def test_op6_against_plain_ftrl():
    r = random.Random(16)
    texts = [prose(r, r.randint(0, 40), 30) for _ in range(150)] + ["", None]
    at = op6_toxicity.coordinates(pa.array(texts))
    assert len(at) == len(texts) and all(x[0] == op6_toxicity.BIAS and (np.diff(x) > 0).all() for x in at)
    labels = [int("abc1" in (t or "") or r.random() < 0.3) for t in texts]
    z, n = {}, {}
    a, b, l1 = op6_toxicity.ALPHA, op6_toxicity.BETA, op6_toxicity.L1

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - l1 * (1 if v > 0 else -1)) / ((b + n.get(i, 0.0) ** 0.5) / a + op6_toxicity.L2)

    for _ in range(op6_toxicity.PASSES):
        for x, y in zip(at, labels):
            w = {i: weight(i) for i in x.tolist()}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in w:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / a * w[i]
                n[i] = before + g * g
    model = op6_toxicity.learnt(list(zip(at, labels)))
    every = np.array(sorted(n))
    assert np.allclose(model.weights(every), [weight(i) for i in every.tolist()]) and np.count_nonzero(model.weights(every)) > 3
    assert not np.delete(model.n, every).any()


def test_op6_repeated_ids_and_columns(spark):
    rows = [(i, f"word{i % 7} " * (1 + i % 5) + ("scummy" if i % 4 == 0 else "kind"), 0.5, i) for i in range(300)] + [(4, "another text", 0.5, 1), (None, "scummy", 0.5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, toxic long")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(300)], "doc_id long, toxic int, text string")
    one, two = (sorted((x["doc_id"] or -1, x["score"], x["toxic"]) for x in op6_toxicity.toxicity(d, labels).collect()) for d in (docs, docs.repartition(7)))
    assert one == two and len(one) == 302


def test_op7(spark, docs, corpus):
    found = op7_substring.repeated_passages(docs).toPandas()
    grams = {}
    for i, t in corpus:
        w = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        for k in range(len(w) - 50):
            grams.setdefault(tuple(x[2] for x in w[k : k + 51]), []).append((i, w[k][0], w[k + 50][1]))
    cut = {}
    for row in found[found["removed"]].itertuples():
        cut.setdefault(row.doc_id, []).append((row.start, row.end))
    for places in grams.values():
        first = min(p[0] for p in places)
        if any(p[0] != first for p in places) and len({w for w in tokens(corpus[first][1])}) > 40:
            for i, a, b in places:
                if i != first:
                    assert any(s <= a and b <= e for s, e in cut.get(i, [])), (i, a, b)
    lines = [i for i, t in corpus if (t or "").startswith("one common line")]
    assert not set(lines) & set(found["doc_id"])
    kept = {r["doc_id"]: r for r in op7_substring.without_repeats(docs).collect()}
    assert len(kept) == len(corpus)
    for i, t in corpus:
        keep = np.ones(len(t or ""), bool)
        for s, e in cut.get(i, []):
            keep[s:e] = False
        assert (kept[i]["text"] or "") == "".join(c for c, k in zip(t or "", keep) if k)
    assert kept[lines[0]]["n_chars"] == len(corpus[lines[0]][1])


def spans_of(a, b):
    sides = []
    for text in (a, b):
        h, first, _, _ = textvec.words(pa.array([text]))
        sides.append(next(textvec.shingles(h, first)))
    return op7_substring._runs(*sides)


def test_op7_phrase_at_other_places():
    r = random.Random(11)
    passage = prose(r, 60, 10**6).split()
    teaser, line = " ".join(passage[27:34]), prose(r, 9, 10**6)
    y = f"{prose(r, 20, 10**6)} {' '.join(passage)} {prose(r, 20, 10**6)}"
    x = f"{prose(r, 30, 10**6)} {teaser} {prose(r, 90, 10**6)} {' '.join(passage)} {prose(r, 30, 10**6)}"
    assert any(s <= 20 and e >= 80 for s, e, _, _ in spans_of(x, y))
    first, mid, last = prose(r, 40, 10**6), prose(r, 30, 10**6), prose(r, 40, 10**6)
    y, x = f"{first} {mid} {last}", f"{first} {mid} {line} {mid} {last}"
    spans = spans_of(x, y)
    for at in range(60):  # windows of 51 words: each lies in x as a whole
        if at + 51 <= 70 or at >= 40:
            assert any(s <= at and at + 51 <= e for s, e, _, _ in spans)
    repeated = " ".join([line, prose(r, 3)] * 12)
    assert spans_of(f"{prose(r, 10)} {repeated}", f"{prose(r, 25)} {repeated}")


def test_op7_one_place_is_enough():
    p = prose(random.Random(2), 70, 10**6)
    gap = prose(random.Random(3), 40, 10**6)
    assert len(spans_of(f"{p} {gap} {p} {gap[::-1]} {p}", p + " " + gap[::-1].upper())) == 1
    assert len(spans_of(f"{gap} {p} {gap[::-1]} {p}", f"zz {p} zz")) == 1


def test_op7_recall_of_bands(spark):
    r = random.Random(3)
    rows, trials = [], 1500
    for i in range(trials):  # one word of fifty edited: Jaccard 0.75 or more
        words = prose(r, 50, 10**6).split()
        copy = list(words)
        copy[r.choice([k for k in range(50)])] = "edited"
        rows += [(i, f"{prose(r, 30, 10**6)} {' '.join(words)} {prose(r, 30, 10**6)}"), (i + trials, f"{prose(r, 30, 10**6)} {' '.join(copy)} {prose(r, 30, 10**6)}")]
    keys = op7_substring.paragraph_keys(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    met = keys.merge(keys, on="key").query(f"doc_id_x + {trials} == doc_id_y").assign(band=lambda k: k["key"] & 7).groupby("doc_id_x")["band"].nunique()
    assert len(met) >= 0.98 * trials and (met >= op7_substring.LEAST_BANDS[0]).sum() >= 0.85 * trials
    odd = spark.createDataFrame([(1, prose(random.Random(1), 50, 10**6)), (2, "a b"), (3, None), (4, prose(random.Random(1), 49, 10**6))], "doc_id long, text string")
    keys = op7_substring.paragraph_keys(odd).collect()
    assert {k["doc_id"] for k in keys} == {1} and len({k["key"] for k in keys}) == op7_substring.BANDS


def passages_found(found, planted):
    """Shares of each (id, start, end) that found passages of the id cover."""
    shares = []
    for i, a, b in planted:
        seen = np.zeros(b - a, bool)
        for row in found[found["doc_id"] == i].itertuples():
            seen[max(0, row.start - a) : max(0, row.end - a)] = True
        shares.append(seen.mean())
    return shares


@pytest.mark.parametrize("scattered", ["phrases", "a line", "half"])
def test_op7_earlier_documents_hide_no_passage(spark, scattered):
    r = random.Random(21)
    passages = [prose(r, 60, 10**6).split() for _ in range(15)]
    docs, planted = [], []
    for i in range(10):  # earlier documents that hold words of every passage
        parts = []
        for p in passages:
            if scattered == "phrases":
                parts += [" ".join(p[k : k + 5]) + " " + prose(r, 3, 10**6) for k in range(0, 56, 5)]
            else:
                parts.append(" ".join(p[10:40] if scattered == "a line" else p[: 36 + i % 5]) + " " + prose(r, 30, 10**6))
        docs.append((i, " ".join(parts)))
    for i, p in enumerate(passages):
        for k in (100 + i, 200 + i):
            lead = prose(r, 30, 10**6) + " "
            docs.append((k, lead + " ".join(p) + " " + prose(r, 30, 10**6)))
            planted.append((k, len(lead), len(lead) + len(" ".join(p))))
    found = op7_substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    late = found[found["doc_id"] >= 100]
    assert min(passages_found(late, planted)) > 0.9
    assert set(late[late["removed"]]["doc_id"]) >= set(range(200, 215))


def test_op7_near_passages_against_brute_force(spark):
    """Of paragraphs of 50 words at Jaccard 0.75 or more, a share of 0.97 is found; the
    brute force compares all of them."""
    r = random.Random(22)
    docs, planted = [], []
    for i in range(120):
        words = prose(r, 50, 10**6).split()
        copy = list(words)
        copy[r.randrange(50)] = "edited"
        copy[r.choice((0, 49))] = "changed"
        a, b = ({tuple(w[k : k + 5]) for k in range(46)} for w in (words, copy))
        lead = prose(r, 40, 10**6) + " "
        docs += [(i, f"{prose(r, 25, 10**6)} {' '.join(words)} {prose(r, 40, 10**6)}"), (1000 + i, lead + " ".join(copy) + " " + prose(r, 20, 10**6))]
        if 100 * len(a & b) >= 75 * len(a | b):
            planted.append((1000 + i, len(lead), len(lead) + len(" ".join(copy))))
    assert len(planted) > 30
    found = op7_substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    assert np.mean([s > 0.7 for s in passages_found(found, planted)]) >= 0.97
    assert set(found["doc_id"]) <= {i for i, _ in docs}


@pytest.mark.parametrize("shape", ["one band", "chain"])
def test_op7_no_link_is_left_out_by_rounds(spark, monkeypatch, shape):
    """Two documents of one key that collide in a single band, where an earlier one holds
    another half of the passage; a passage that only a covered document shares."""
    r = random.Random(24)
    p = prose(r, 120, 10**6).split()
    if shape == "one band":
        texts = {1: p[20:52], 2: p[:72], 3: p[:72]}
        want = {(2, 3)}
    else:  # 1 and 2 share a passage, 2 and 3 another one around the same key, 1 and 3 less
        texts = {1: p[:64], 2: p[:100], 3: p[36:100]}
        want = {(1, 2), (2, 3)}
    rows = [(i, " ".join([prose(r, 40, 10**6), *t, prose(r, 40, 10**6)])) for i, t in texts.items()]
    lead = 40  # the key's place is word 48 of p, which all of them hold
    at = {1: lead + (28 if shape == "one band" else 48), 2: lead + 48, 3: lead + (48 if shape == "one band" else 12)}
    keys = spark.createDataFrame([(i, 8, a) for i, a in at.items()], "doc_id long, key long, at int")
    monkeypatch.setattr(op7_substring, "paragraph_keys", lambda _: keys)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = op7_substring.shared_passages(docs, Work(spark, "rounds"))
    assert {(x["a"], x["b"]) for x in found.collect()} >= want


def test_passages_cut_what_only_a_covered_document_shares(spark, monkeypatch, tmp_path):
    r = random.Random(25)
    p = prose(r, 120, 10**6).split()
    texts = {1: p[:64], 2: p[:100], 3: p[36:100]}
    rows = [(i, " ".join([prose(r, 40, 10**6), *t, prose(r, 40, 10**6)])) for i, t in texts.items()]
    keys = spark.createDataFrame([(1, 8, 88), (2, 8, 88), (3, 8, 52)], "doc_id long, key long, at int")
    monkeypatch.setattr(op7_substring, "paragraph_keys", lambda _: keys)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x["doc_id"]: x["text"] for x in corpus_pipeline.passages(spark, docs, str(tmp_path)).collect()}
    assert kept[1] == rows[0][1] and " ".join(p[40:96]) not in kept[3]


def test_passages_of_a_second_place_of_a_key(spark, monkeypatch, tmp_path):
    """1, 2 and 3 share a passage; 2 and 3 share another one that meets by the same key."""
    r = random.Random(26)
    common, edges = prose(r, 40, 10**6), [prose(r, 20, 10**6) for _ in range(4)]
    one, two = f"{edges[0]} {common} {edges[1]}", f"{edges[2]} {common} {edges[3]}"
    rows = [(i, " ".join([prose(r, 40, 10**6), one, prose(r, 40, 10**6), *([two] if i > 1 else []), prose(r, 40, 10**6)])) for i in (1, 2, 3)]
    docs, keys_of = spark.createDataFrame(rows, "doc_id long, text string"), op7_substring.paragraph_keys
    held = keys_of(docs).where("at between 60 and 100").groupBy("key").agg(F.countDistinct("doc_id").alias("n")).where("n = 3").toPandas()
    key = int(held["key"].min())
    monkeypatch.setattr(op7_substring, "paragraph_keys", lambda x: keys_of(x).where(F.col("key") == key))
    kept = {x["doc_id"]: x["text"] for x in corpus_pipeline.passages(spark, docs, str(tmp_path)).collect()}
    assert kept[1] == rows[0][1] and one not in kept[2] and two in kept[2]
    assert one not in kept[3] and two not in kept[3]


def test_op7_pairs_grow_as_the_group(spark, monkeypatch):
    """Near copies of a paragraph, each edited at places of its own: the pairs that are
    compared are a few for each, and passages cover as much as all pairs show."""
    r = random.Random(27)
    base, texts = prose(r, 150, 10**6).split(), []
    for i in range(90):
        words = list(base)
        for k in r.sample(range(150), 9):
            words[k] = f"edit{i}x{k}"
        texts.append(f"{prose(r, 20, 10**6)} {' '.join(words)} {prose(r, 20, 10**6)}")
    docs, compared, matches = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [], op7_substring._matches

    def counted(pairs, docs):
        compared.append(pairs.count())
        return matches(pairs, docs)

    monkeypatch.setattr(op7_substring, "_matches", counted)
    found = op7_substring.repeated_passages(docs).toPandas()
    assert sum(compared) <= 6 * len(texts)
    monkeypatch.undo()
    every = [(i, j) for j in range(len(texts)) for i in range(j)]
    spans = op7_substring._matches(spark.createDataFrame(every, "a long, b long"), docs).toPandas()
    share = passages_found(found, sorted({(int(x.b), int(x.b_start), int(x.b_end)) for x in spans.itertuples()}))
    assert np.mean(share) >= 0.97


def around_key(rows):
    """Arguments of _bucket for (document, words, place of the key's shingle)."""
    texts = [next(op7_substring._texts(pa.array([" ".join(w)]))).shingles for _, w, _ in rows]
    return [d for d, _, _ in rows], [k for _, _, k in rows], [0] * len(rows), [(t >> np.uint64(32)).astype("<u4").tobytes() for t in texts], []


def test_op7_places_are_tested_without_a_search(monkeypatch):
    """Words replaced in one of two texts leave the others side by side: the search for
    passages would give what a look at those gives."""
    r, searched, runs = random.Random(26), [], op7_substring._runs
    rows = []
    for i in range(300):
        words = prose(r, 105, 10**9).split()
        copy = [w if 45 <= k < 60 or r.random() > 0.06 else "zz" + str(r.randrange(10**9)) for k, w in enumerate(words)]
        cut = r.choice((0, 0, 20))  # a text that begins there
        rows.append([(2 * i, words, 50), (2 * i + 1, copy[cut:], 50 - cut)])
    want = []
    for (_, x, x_at), (_, y, y_at) in rows:
        x, y = (next(op7_substring._texts(pa.array([" ".join(w)]))).shingles for w in (x, y))
        want.append(op7_substring._passage_at(x, y, x_at, y_at))
    assert 50 < sum(w is not None for w in want) < 250
    monkeypatch.setattr(op7_substring, "_runs", lambda x, y: searched.append(1) or runs(x, y))
    found = [op7_substring._bucket(*around_key(pair)) for pair in rows]
    for span, got in zip(want, found, strict=True):
        assert [g[2:6] for g in got] == ([span] if span else [])
    assert not searched


def test_op7_exact_passages_of_texts_that_repeat_themselves(monkeypatch):
    """A line over and over with a passage that another text has too, at another line."""
    r, runs = random.Random(27), []
    monkeypatch.setattr(op7_substring, "_runs", lambda x, y: runs.append(1) or [])
    line, passage = prose(r, 16, 10**9).split(), prose(r, 28, 10**9).split()
    x = prose(r, 20, 10**9).split() + line + passage + line
    y = line + line + passage + line
    assert [g[:2] for g in op7_substring._bucket(*around_key([(1, x, 26), (2, y, 22)]))] == [(1, 2)] and not runs


def test_op7_repeated_ids(spark):
    r = random.Random(23)
    passage = prose(r, 70, 10**6)
    texts = [f"{prose(r, 30, 10**6)} {passage} {prose(r, 30, 10**6)}" for _ in range(3)]
    rows = [(1, texts[0]), (2, texts[1]), (2, texts[2]), (2, texts[2]), (2, None), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(x["doc_id"], x["text"]) for x in op7_substring.without_repeats(docs).collect()]
    assert len(kept) == 6 and (1, texts[0]) in kept
    assert sum(passage in (t or "") for i, t in kept if i is not None) == 1 and (None, texts[0]) in kept and (2, None) in kept
    found = op7_substring.repeated_passages(docs).toPandas()
    assert set(found["doc_id"]) == {1, 2}


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(8)
    x = r.normal(size=(700, 16))
    for i in range(300, 500):
        x[i] = x[i % 20] + r.normal(size=16) * r.choice((0.05, 0.15, 0.25))
    x[500:520] = x[7]
    rows = [(i, v.astype("float32").tolist()) for i, v in enumerate(x)]
    rows += [(700, None), (701, []), (702, [0.0] * 16), (703, [float("nan")] + [1.0] * 15), (704, [float("inf")] + [1.0] * 15), (705, [1.0, None] + [0.0] * 14), (706, [1.0, 2.0]), (707, [2.0, 4.0]), (0, rows[0][1])]
    return rows


def finite(v):
    return v and all(c is not None and np.isfinite(c) for c in v)


@pytest.mark.parametrize("dim", [2, 3, 4, 16, 64])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_op8_every_link_in_few_and_many_dimensions(spark, dim, kind):
    if kind == "double" and dim != 4:
        return
    r = np.random.default_rng(dim)
    x = r.normal(size=(900, dim))
    x[300:] = x[r.integers(0, 300, 600)] + r.normal(size=(600, dim)) * r.choice((0.05, 0.2, 0.3), (600, 1))
    x = x.astype("float32" if kind == "float" else "float64")
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = op8_vectors.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).toPandas().set_index("vec_id").sort_index()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(900, dtype=bool)
    assert got["n_links"].tolist() == near.sum(axis=1).tolist()
    want = classes(range(900), zip(*np.nonzero(np.triu(near))))
    assert got["component_id"].to_dict() == want


@pytest.mark.parametrize("block", [1024, 16])
def test_op8(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(op8_vectors, "BLOCK", block)
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))
    got = {r["vec_id"]: r for r in op8_vectors.near_vectors(frame).collect()}
    own = {i: np.array(v, float) for i, v in vectors if finite(v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in own.items()}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a].size == unit[b].size and unit[a] @ unit[b] >= 0.95]
    degree = {i: 0 for i, _ in vectors}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert {i: r["n_links"] for i, r in got.items()} == degree
    want = classes(degree, links)
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_op9(spark, vectors, monkeypatch):
    monkeypatch.setattr(op9_topk, "CHUNK", 100)
    monkeypatch.setattr(op9_topk, "BLOCK", 7)
    frame = op9_topk.valid(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    got = op9_topk.top_k(frame, frame.where("vec_id % 50 = 0 or vec_id = 706")).toPandas()
    own = {i: np.floor(256 * np.array(v, float)) for i, v in vectors if finite(v)}
    for q in [i for i in own if i % 50 == 0 or i == 706]:
        want = sorted((-int(own[q] @ v), i) for i, v in own.items() if i != q and v.size == own[q].size)[:5]
        rows = got[got["query_id"] == q].sort_values("rank")
        assert list(zip(-rows["score"], rows["vec_id"])) == want and rows["rank"].tolist() == list(range(1, len(want) + 1))


def test_op9_queries_are_not_broadcast(spark, vectors):
    """They are sent to every salt, which Spark's estimate of their size leaves out."""
    frame = spark.createDataFrame([(i, v) for i, v in vectors if i < 600], "vec_id long, embedding array<float>")
    found = op9_topk.top_k(op9_topk.valid(frame), op9_topk.valid(frame).where("vec_id % 50 = 0"))
    assert found.count() and len(found.collect()) == 60
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_op9_large_weights(spark):
    r = np.random.default_rng(9)
    x = [(r.normal(size=5) * 10.0 ** r.choice((0, 4, 9, 17, 30))).tolist() for _ in range(120)] + [[1e307] * 5, [-1e307] * 5]
    rows = [(i, v, 1) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>, score int")
    got = op9_topk.top_k(frame, frame.where("vec_id % 10 = 0")).toPandas()
    whole = lambda c: 256 * int(c) if abs(c) > 2**52 else int(np.floor(256 * c))
    own = [[whole(c) for c in v] for v in x]
    for q in range(0, 122, 10):
        want = sorted((-sum(a * b for a, b in zip(own[q], v)), i) for i, v in enumerate(own) if i != q)[:5]
        found = got[got["query_id"] == q].sort_values("rank")
        assert found["score"].tolist() == [max(-(2**63), min(2**63 - 1, -s)) for s, _ in want]
        if all(abs(s) < 2**63 for s, _ in want):
            assert found["vec_id"].tolist() == [i for _, i in want]


def test_op10(spark, docs, corpus):
    import tiktoken

    path, pattern = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = op10_bpe.codec(path, pattern)
    r = random.Random(10)
    letters = [*"aAbBeéß ñ.,!?'sdt019  \n\n\t\r\x0b\x1c\x1d\x85\xa0 日本語́🙂‍Σς#½Ⅷ٣", "'s", "<|endoftext|>", " the", "   ", "\n\n"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(4000)] + [t or "" for _, t in corpus]
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(t), t
        assert own.decode(ids) == t.encode() and "".join(chunks.with_space(t)) == t
    out = {x["doc_id"]: x for x in op10_bpe.digests(docs, path, pattern).collect()}
    for i, t in corpus:
        ids = plain.encode_ordinary(t or "")
        assert (out[i]["n_tokens"], out[i]["ids_sha256"], out[i]["decoded_sha256"]) == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((t or "").encode()).hexdigest())
    both = op10_bpe.encode(docs, path, pattern, offsets=True)
    back = {x["doc_id"]: x["text"] for x in op10_bpe.decode(both, path, pattern).collect()}
    assert back == {i: t or "" for i, t in corpus}
    text = "日本🙂 ab"
    spans = own.offsets(text, own.encode([text])[0])
    assert spans[0][0] == 0 and spans[-1].tolist() == [3, 6] and (np.diff(spans[:, 0]) >= 0).all()


def test_table_of_chunks_turns_over():
    calls = []
    table = chunks.Table(lambda x: calls.append(len(x)) or [c.encode() for c in x], most=4)
    for texts in (["a", "b"], ["c", "d"], ["a", "e"], ["f", "g", "h", "i", "j"]):
        assert table([texts]) == ["".join(texts).encode()]


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], EMPTY)
    assert op1_minhash.near_duplicates(docs).count() == op7_substring.repeated_passages(docs).count() == op2_pii.detect(docs).count() == 0
    assert op3_packing.packed(docs, op3_packing.tokenizer_path()).count() == op7_substring.without_repeats(docs).count() == 0
    assert op6_toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert op5_chat.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op8_vectors.near_vectors(empty).count() == op9_topk.top_k(empty, empty).count() == 0
    assert op4_html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, docs, corpus, tmp_path):
    toxic = [(2000 + i, f"{prose(random.Random(i), 60)} scummy idiotic") for i in range(60)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [*corpus, *toxic]] + [(3000, "mail a@b.org now", "en", "s", 16)] * 2 + [(None, "no id", "en", "s", 5)]
    spark.createDataFrame(rows, EMPTY).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 0) for i, _ in corpus] + [(i, 1) for i, _ in toxic[:50]]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "passages", "privacy", "packing"]
    state, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        state = spark.createDataFrame(stage(spark, state, str(tmp_path)).collect(), EMPTY)
        seen[name] = {r["doc_id"]: r["text"] for r in state.collect()}
    assert not {i for i, _ in toxic} & set(seen["toxicity"]) and {i for i, _ in corpus} <= set(seen["toxicity"])
    sets = {i: shingle_set(t) for i, t in seen["near_dedup"].items() if i is not None}
    assert not [1 for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert state.where("doc_id = 3000").count() == 1 and seen["privacy"][3000] == "mail [EMAIL] now" and seen["privacy"][None] == "no id"
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out["doc_id"].dropna()) == {i for i in seen["privacy"] if i is not None}


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Empty tables, repeated ids with the same and with other texts, extra columns of
    clashing names: what the stages' docstrings say."""
    r = random.Random(31)
    a, b, c = prose(r, 120, 10**6), prose(r, 120, 10**6), prose(r, 120, 10**6)
    shape = EMPTY + ", key long, kept boolean, a string, score double"
    rows = [(i, t, "en", x, len(t or ""), 1, True, "x", 0.5) for i, t, x in [(1, a, "s"), (1, a, "r"), (1, b, "s"), (2, b, "s"), (3, c, "s"), (4, None, "s"), (4, "", "s"), (None, c, "s"), (None, None, "s")]]
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for data in ([], rows):
        docs = spark.createDataFrame(data, shape)
        seen = {}
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
            docs = spark.createDataFrame(out.collect(), shape)
            seen[name] = sorted((x["doc_id"] or -1, x["text"] or "", x["source"]) for x in docs.collect())
        assert corpus_pipeline.packing(spark, docs, str(tmp_path)).count() == len(seen["privacy"])
    assert len(seen["toxicity"]) == 9
    least = min(a, b)  # the least text of id 1 has that id; its other text is a document by itself
    want = [(1, a, "r"), (3, c, "s"), (4, "", "s"), (4, "", "s"), (-1, c, "s"), (-1, "", "s"), (1, b, "s") if least == b else (2, b, "s")]
    assert seen["near_dedup"] == sorted(want)
    assert [x[0] for x in seen["passages"]] == [x[0] for x in seen["near_dedup"]]


def test_packing_and_search_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, "x", 5), (1, "a b c", 2, "x", 5), (None, None, 3, "x", 5)], "doc_id long, text string, start long, ids string, length int")
    out = op3_packing.packed(docs, op3_packing.tokenizer_path()).collect()
    assert sorted((x["doc_id"] or 0, x["start"], x["length"]) for x in out) == [(0, 0, 1), (1, 0, 4), (1, 0, 4)]
    vectors = spark.createDataFrame([(i, [float(i), 1.0], 1, 2, 3) for i in range(60)], "vec_id long, embedding array<double>, score int, rank int, dim int")
    frame = op9_topk.valid(vectors)
    assert op9_topk.top_k(frame, frame.where("vec_id % 50 = 0")).count() == 10
