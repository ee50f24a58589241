"""Extraction, fingerprints, scores, pseudonyms, notices, tokens and toxicity against plain versions."""

from __future__ import annotations

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from data import EDGES, frame  # noqa: E402

from ledgerlens.llm import bpe, digest, notices, pseudonyms, suffix_tree, toxicity  # noqa: E402
from ledgerlens.llm.common import UPPER  # noqa: E402
from ledgerlens.llm.html import extract_text  # noqa: E402

LOWER = str.maketrans(UPPER, UPPER.lower())


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_article_only():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="ad">Buy</div>
    <article class=post><h1>Title &amp; more</h1><p>One\n two<br>three <b>bold<p>Short.
    <div class="share-buttons">Share</div><form>Mail <input></form><p>A &lt; B &eacute;</p><aside>Side</aside>
    <section id="comments"><p>First!</p></section></article>
    <div class=notice>Cookies</div><footer>&copy; us</footer></body></html>"""
    assert extract_text(page) == "Title & more\n\nOne two three bold\n\nShort.\n\nA < B é"


def test_surge_and_dive_without_article():
    text = "A sentence that is long enough to be the body of the page, and then some more of it."
    links = "".join(f"<li><a href={i}>link {i}</a></li>" for i in range(9))
    page = f"<body><ul>{links}</ul><div>{text}</div><div>Short one.</div><div>{text}</div><ul>{links}</ul><div>end</div>"
    assert extract_text(page) == f"{text}\n\nShort one.\n\n{text}"


def test_pages_of_the_table(spark, sf):
    from ledgerlens.llm.queries import op1_line_blocks

    got = {r["page_id"]: r for r in op1_line_blocks(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    import html

    for p in pages:  # in these pages the article holds headings and paragraphs only
        body = re.search(r"<article>(.*)</article>", p["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[p["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])


def test_entropy_of_windows():
    raw = np.frombuffer(os.urandom(300) + b"a" * 200 + b"abcabc" * 30, dtype=np.uint8)
    steps = digest.entropies(raw)
    for i in range(len(steps)):
        n = Counter(raw[i : i + 64].tolist())
        spread = sum(int(digest._PLOGP[c]) for c in n.values())
        whole = 6 * 64 * digest._ONE
        assert steps[i] == digest.STEPS * (whole - spread) // whole


def test_likeness():
    ranks = np.arange(digest.STEPS + 1)
    rng = np.random.default_rng(1)
    one, two = ("".join(map(chr, rng.integers(97, 123, 6000))) for _ in range(2))
    a, b, half = (digest.fingerprint(t, ranks) for t in (one, two, one[:3000] + two[:3000]))
    assert digest.likeness(a, a) == 1 and digest.likeness(a, b) < 0.1 < 0.3 < digest.likeness(a, half)
    assert (digest.from_hex(digest.to_hex(a)) == a).all()
    empty = digest.fingerprint("", ranks)
    assert digest.likeness(empty, empty) == 1 and digest.likeness(empty, a) == 0


@pytest.mark.parametrize("rows_per_bucket", [1, 3, 1000])
def test_neighbours(spark, rows_per_bucket):
    rows = [(i * 7 % 41, f"text {i} " * (i % 9)) for i in range(41)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    dealt = digest.with_neighbours(table, rows_per_bucket)
    per_bucket: dict = {}
    for r in dealt.collect():
        per_bucket.setdefault(r["bucket"], []).append(r)
    following = {}
    for held in per_bucket.values():
        for x, y in zip(held, held[1:], strict=False):
            following[x["doc_id"]] = y["doc_id"]
    assert following == {i: (i - 1) % 41 for i in range(41)}


def test_edited_texts(docs):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in digest.compare_edited(docs).collect()}
    ranks = np.array(digest.entropy_ranks(docs))
    for (i, text), (_, other) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        own = digest.fingerprint(text, ranks)
        assert got[i]["edited"] == edited and got[i]["n_chars"] == len(text)
        assert got[i]["fingerprint"] == digest.to_hex(own)
        assert got[i]["near_edited"] == pytest.approx(digest.likeness(own, digest.fingerprint(edited, ranks)))
        assert got[i]["near_next"] == pytest.approx(digest.likeness(own, digest.fingerprint(other, ranks)))


@pytest.mark.parametrize("head", [5, 50_000])
def test_scores(docs, head):
    rows = {r["doc_id"]: suffix_tree.words_of((r["text"] or "").translate(LOWER)) for r in docs.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    counts = Counter(w for i, t in rows.items() if not out[i] for w in [*t, "\n"])
    total, mass = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    for r in suffix_tree.score_texts(docs, head).collect():
        t = [*rows[r["doc_id"]], "\n"]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (out[r["doc_id"]], len(t), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in t)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / mass) for w in t), rel=1e-9)
        assert r["score"] < 0


def test_tree_distributions_sum_to_one(spark):
    texts = ["abracadabra abracadabra", "abra cadabra", "banana"] * 40
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    tree = suffix_tree.fit_tree(suffix_tree.corpus_counts(table), min_share=1e-4, worth=0.1)
    assert sum(len(level[0]) for level in tree.levels[1:]) > 5
    for context in (b"\n\n\n\n\n", b"abrac", b"zzzzz", b"anana", b"a bra"):
        base = int.from_bytes(context[::-1], "big") << 8
        p = 10 ** tree.log10(np.arange(256, dtype=np.int64) + base)
        assert p.sum() == pytest.approx(1)
    codes, starts = suffix_tree.gram_codes([["ab", "c"], [], ["x"]])
    assert [c & 255 for c in codes.tolist()] == list(b"ab c\n\nx\n") and starts.tolist() == [0, 5, 6]
    assert codes[0] == int.from_bytes(b"\n\n\n\n\na", "big") and codes[4] == int.from_bytes(b"c ba\n\n", "big")


def test_notices_against_plain_search(docs):
    rows = [(r["doc_id"], (r["text"] or "").translate(LOWER)) for r in docs.collect()]
    rows += [(10**6, "x licenced undr the apache license, version 2.0! CC BY cc by".translate(LOWER))]
    for _, text in rows:
        got = notices.scan(text)
        words = notices.WORD.findall(text)
        places = []
        for phrase, label in notices.PHRASES.items():
            want = phrase.split()
            places += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
        assert got["n_words"] == len(words) and got["n_base"] == len(places)
        assert got["first_word"] == min((i for i, _ in places), default=None)
        assert got["last_word"] == max((i for i, _ in places), default=None)
        assert got["base_labels"] == ",".join(sorted({x for _, x in places}))
        joined = " ".join(words)
        if len(joined) < 3000:  # without seeds
            found = {n.label for n in notices._notices if n.pattern.search(joined)}
            assert {s["label"] for s in got["spans"]} <= found
    assert got["labels"] == "apache-2.0,cc-by" and got["n_base"] == 2
    assert [s for s in got["spans"] if s["label"] == "apache-2.0"][0]["edits"] == 2


def test_pseudonyms(spark):
    def run(*texts, key="k"):
        table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
        out = pseudonyms.pseudonymise(table, key)
        return [r["text"] for r in out.orderBy("row.doc_id").collect()]

    card, phone = "4111 1111 1111 1111", "+1 (017) 555-7713"
    texts = [
        f"a {card} b {phone}, 10.20.30.40. on 2020-02-29 x@y.org",
        f"{card.replace(' ', '')} and 29/02/2020 or 078-05-1120",
        "left: 4111111111111112 2021-02-30 999.1.1.1 000-12-3456 12345 4.0. v1.2.3.4.5",
        "",
        None,
    ]
    one, two, three, four, five = run(*texts)
    shape = r"a (\d{4} \d{4} \d{4} \d{4}) b (\+1 \(\d{3}\) \d{3}-\d{4}), (\d+\.\d+\.\d+\.\d+)\. on (\d{4}-\d\d-\d\d) ([a-p]@y\.org)"
    got = re.fullmatch(shape, one).groups()
    assert not set(got) & {card, phone, "10.20.30.40", "2020-02-29", "x@y.org"}
    y, m, d = got[3].split("-")
    assert two.startswith(got[0].replace(" ", "") + f" and {d}/{m}/{y} or ") and "078-05-1120" not in two
    digits = [int(c) for c in got[0].replace(" ", "")]
    assert sum(digits[1::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[0::2]) and len(digits) == 16
    assert (sum(digits[1::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[0::2])) % 10 == 0
    assert three == texts[2] and four == "" and five == ""
    assert run(texts[0]) == [one] and run(texts[0], key="other") != [one]


def test_feistel_is_a_permutation(spark):
    side = [F.lit(x).cast("bigint") for x in (12, 25)]
    left, right = F.floor(F.col("id") / 25), F.col("id") % 25
    out = spark.range(300).select(pseudonyms.feistel("k", "t", left, right, *side).alias("s")).distinct().collect()
    assert len(out) == 300 and all(0 <= r["s"]["l"] < 12 and 0 <= r["s"]["r"] < 25 for r in out)


def test_tokens_against_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    more = frame(spark, [(10**6 + i, r[1], "", "", 0) for i, r in enumerate(EDGES)]).select("doc_id", "text")
    odd = ["a\x1cb\x85c​d\xa0 　e", "don't  DON'T\r\n\t x", "<|endoftext|><|endoftext|>a<|endoftext|> "]
    more = more.unionByName(frame(spark, [(2 * 10**6 + i, t, "", "", 0) for i, t in enumerate(odd)]).select("doc_id", "text"))
    table = docs.select("doc_id", "text").unionByName(more)
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    for r in bpe.digests(table).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want = library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_toxicity_on_held_out_rows(spark):
    words = "calm river stone walks under bright clouds while seven birds sing along old roads".split()
    rows = []
    for i in range(900):
        text = [words[(i * 7 + j * j) % len(words)] for j in range(30)]
        if i % 5 == 0:
            for j, w in enumerate(("idiot", "1d1ot", "worthless")[: 1 + i % 3]):
                text[(i + j * 9) % 30] = w
        rows.append((i, " ".join(text), "en", "s", 0))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(900)], "doc_id bigint, quality int, toxic int")
    out = toxicity.score_toxicity(frame(spark, rows), labels).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 100
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    right = sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held) / len(held)
    assert right > 0.97 and all(0 <= r["score"] <= 1 for r in out)


def test_features_of_disguised_insults():
    f = toxicity.text_features("You 1d1ot! s t u p i d and lo-ser, calm day")
    assert f[9] == pytest.approx(math.log1p(3)) and f[11] >= 1
    assert toxicity.text_features("") == [0.0] * len(f)
