"""Dealt operators on small tables: odd rows, exact expectations, brute force."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from feedback_engine.llm import (
    ann,
    exact_dedup,
    language_id,
    licenses,
    main_text,
    mixing,
    near_dedup,
    packing,
    pii,
    token_counts,
)
from feedback_engine.llm.common import ship_code

DOCS = "doc_id long, text string, lang string, source string, n_chars long, N_WORDS int, __again string"
WORDS = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    ship_code(spark)
    rows = [
        (1, WORDS, "en", "a", 1, 0, None),
        (2, WORDS.replace(" ", "\n "), "en", "a", 1, 0, None),
        (3, WORDS + " more", None, "b", None, None, "x"),
        (4, None, "de", None, 1, 0, None),
        (5, "", "de", "b", 1, 0, None),
        (6, " \t\n", None, None, None, None, None),
        (7, "two words", "fr", "c", 1, 0, None),
        (7, "two words", "fr", "c", 1, 0, None),
        (8, "TWO Words", "fr", "c", 1, 0, None),
        (None, "no id at all here", "en", "a", 1, 0, None),
        (9, "word " * 30_000, "en", "a", 1, 0, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_exact_dedup(docs, nothing):
    found = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs).collect()}
    assert (found[2].keep_id, found[2].group_size, found[2].kept) == (1, 2, False)
    assert found[4].kept and found[5].keep_id == 4 and found[4].group_size == 2  # null is empty
    assert found[6].group_size == 1 and found[None].kept  # blank becomes one space
    assert found[8].kept and found[7].group_size == 2 and found[7].kept
    assert found[7].text_sha256 == hashlib.sha256(b"two words").hexdigest()
    assert exact_dedup.exact_duplicates(docs).count() == docs.count()
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "6", "7", "8", "9", "None"]
    assert exact_dedup.exact_duplicates(nothing).count() == 0 and exact_dedup.drop_exact_duplicates(nothing).count() == 0


def test_exact_dedup_with_a_full_filter(docs):
    few = exact_dedup.exact_duplicates(docs, most_words=1).drop("text_sha256")
    assert sorted(map(str, few.collect())) == sorted(map(str, exact_dedup.exact_duplicates(docs).drop("text_sha256").collect()))


def test_near_dedup(docs, nothing):
    found = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert [found[i].component_id for i in (1, 2, 3)] == [1, 1, 1] and found[1].n_shingles == 56
    assert [found[i].n_shingles for i in (4, 5, 6)] == [0, 0, 0] and found[5].component_id == 5
    assert found[7].component_id == 7 == found[8].component_id and not found[8].kept
    assert found[9].n_shingles == 1 and found[None].kept
    assert near_dedup.near_duplicates(nothing).count() == 0
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, 7, 9, None}


def _shingles(text):
    words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_dedup_of_a_large_group_against_brute_force(spark):
    """Copies with changes of their own (more than a short list holds), and a passage that others share."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(220)]
    passage = [f"p{i}" for i in range(70)]
    texts = []
    for i in range(70):
        own = list(base)
        for at in rng.choice(len(own), int(rng.integers(1, 12)), replace=False):
            own[at] = f"x{i}_{at}"
        texts.append(own)
    for i in range(50):
        size = int(rng.integers(20, 120))
        texts.append([f"o{i}_{j}" for j in range(size)] + passage)
    table = spark.createDataFrame([(i * 3, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table).collect()}
    sets = {i * 3: _shingles(" ".join(t)) for i, t in enumerate(texts)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 75 * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    assert found == {i: root(i) for i in sets}


def test_packing(docs, nothing, spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    coding = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["<|endoftext|> ½٣ don't\r\n   x", "a<|endoftext|>", "  <|endoftext|><|endoftext|>  b <|endoftext", "é <|endoftext|>\n"]
    assert coding.encode(texts[1], add_special_tokens=False).ids == [64, 50256]
    odd = spark.createDataFrame([(20 + i, t, "en", "a", 1, 0, None) for i, t in enumerate(texts)], DOCS)
    both = docs.union(odd)
    rows = packing.pack(both, packing.public_vocabulary()).collect()
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 1024
    expected = Counter()
    for d in both.collect():
        ids = np.array([*coding.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        for i, (start, n) in enumerate(packing.cut(len(ids), 1024)):
            expected[(d.doc_id, i, start, n, zlib.crc32(ids[start : start + n].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    assert packing.pack(nothing, packing.public_vocabulary()).count() == 0


def test_bin_plan_uses_each_length_once():
    histogram = {1024: 3, 700: 5, 324: 4, 200: 7, 124: 9, 1: 11}
    plan = packing.plan_bins(histogram, 1024)
    used = Counter()
    for chosen, bins in plan:
        assert sum(length * n for length, n in chosen.items()) <= 1024
        used.update({length: n * bins for length, n in chosen.items()})
    assert used == histogram
    assert packing.fullest(700, {700: 1, 200: 1, 124: 1, 323: 1}, 1024) == {700: 1, 200: 1, 124: 1}


def test_mixing(spark, docs, nothing):
    rng = np.random.default_rng(5)
    sizes = [(i, int(rng.integers(0, 60)), ["a", "b", None, "c"][min(i % 9, 3)]) for i in range(3_000)]
    table = spark.createDataFrame([(i, "w " * n, "en", s, 0, 0, None) for i, n, s in sizes], DOCS)
    rows = mixing.mixed_counts(table).collect()
    assert len(rows) == 3_000 and all(r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0 for r in rows)
    totals, weights, by_id = Counter(), {"a": 3, "b": 1, "c": 2, None: 3}, {i: s for i, _, s in sizes}
    for _, n, s in sizes:
        totals[s] += n
    target, free = {}, set(totals)
    left = 1.5 * sum(totals.values())
    while free:  # what would be above goes to the others by weight
        share = left / sum(weights[s] for s in free)
        above = {s for s in free if share * weights[s] > 2 * totals[s]}
        if not above:
            target |= {s: share * weights[s] for s in free}
            break
        target |= {s: 2.0 * totals[s] for s in above}
        left -= sum(2 * totals[s] for s in above)
        free -= above
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(target[by_id[r.doc_id]]) and r.source_size == totals[by_id[r.doc_id]]
        taken[by_id[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 60 for s in totals)
    assert sorted(mixing.mixed_counts(table.repartition(7)).collect(), key=str) == sorted(rows, key=str)
    copies = mixing.mixed_documents(table)
    assert copies.columns == table.columns and copies.count() == sum(r.taken // r.size for r in rows if r.size)
    odd = mixing.mixed_counts(docs).collect()
    assert len(odd) == 11 and mixing.mixed_counts(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_language_held_out(spark, sf_dir):
    ship_code(spark)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(table.where("doc_id % 2 = 0"))
    held = table.where("doc_id % 2 = 1")
    found = {r.doc_id: r for r in language_id.identify(held, model).collect()}
    truth = {r.doc_id: r.lang for r in held.collect()}
    assert sum(found[i].text_lang == lang for i, lang in truth.items()) >= 0.97 * len(truth)
    assert all(found[i].kept for i in truth)


def test_language_evidence(spark, docs, nothing):
    model = language_id.train(spark.createDataFrame([("the and of with " * 2000, "en"), ("der und von mit " * 2000, "de"), (None, "fr"), ("x", None)], "text string, lang string"))
    assert model.languages == ("de", "en")
    rows = [(i, "the and of the", "h1") for i in range(30)] + [(i, "der und von der", "h2") for i in range(30, 60)]
    rows += [(90, "o", "h1"), (91, "o", "h2"), (92, "жзи " * 40, "h1"), (93, "12 34 !!", "h1"), (94, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, host string")
    found = {r.doc_id: r for r in language_id.identify(table, model, host=table["host"]).collect()}
    assert found[90].lang == "en" and found[91].lang == "de"  # the host decides
    assert not found[92].kept and not found[93].kept and not found[94].kept
    assert len(found) == len(rows)
    from pyspark.sql import functions as F

    assert language_id.identify(docs, model, declared=F.col("lang"), host=F.col("source")).count() == docs.count()
    assert language_id.identify(nothing, model).count() == 0
    assert language_id.keep_known(docs, model).columns == docs.columns
    assert language_id.train(nothing).classes == ("und",)


BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def test_licenses_against_brute_force(spark, docs, nothing, sf_dir):
    odd = spark.createDataFrame(
        [(30, "Under THE (mit) license under the mit license, CC-BY-NC cc by ncé cc by nc", "en", "a", 1, 0, None)], DOCS
    )
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 N_WORDS", "'' __again")
    table = docs.union(odd).unionByName(real)
    found = sorted(map(str, licenses.scan(table).drop("labels", "score").collect()))
    expected = []
    for d in table.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in d.text or ""))
        places = [(i, label) for label, p in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        expected.append(str(Row(
            doc_id=d.doc_id, n_words=len(words), n_base=len(places), first_word=min(starts, default=None),
            last_word=max(starts, default=None), base_labels=",".join(sorted({label for _, label in places})),
        )))
    assert found == sorted(expected)
    assert licenses.scan(nothing).count() == 0


def test_license_text_with_changes(spark):
    text = licenses.TEMPLATES[3].text.replace("any person", "any and every person").replace("copy of this", "copy of")
    row = licenses.scan(spark.createDataFrame([(1, f"intro {text} end"), (2, "under the license of mit")], "doc_id long, text string"))
    found = {r.doc_id: r for r in row.collect()}
    assert found[1].labels == "mit" and found[1].base_labels == "" and 0.6 <= found[1].score < 1
    assert found[2].labels == "" and found[2].score == 0


def test_license_grams_count_once_and_in_order(spark):
    template = next(t for t in licenses.TEMPLATES if t.label == "bsd").text
    head, tail = template.split(" in source ")
    rows = [
        (1, "the gnu general public gnu general public notice"),
        (2, f"in source {tail} {head}"),  # its halves in the wrong order
        (3, f"{head} as well as in source {tail}"),
        (4, "gnu general public license and the gnu general public license"),
    ]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].labels == "" and found[1].score == 0
    assert found[3].labels == "bsd" and found[4].labels == "gpl" and found[4].score == 1
    assert found[2].score < found[3].score


@pytest.mark.parametrize(
    "wrapper", ['<div class="content has-sidebar"><article>%s</article></div>', '<div class="site no-banner"><main>%s</main></div>',
                '<div class="overlay-page"><main>%s</main></div>', '<div id="with-comments"><div>%s</div></div>'],
)
def test_layout_names_do_not_ban_the_article(wrapper):
    text = "An article paragraph that has quite a few words in it, enough to be read as one."
    page = f"<body>{wrapper % f'<h1>Title</h1><p>{text}</p>'}<div class=sidebar><p>{text} again</p></div></body>"
    assert main_text.main_text(page) == f"Title {text}"
    assert main_text.main_text(f'<div class="comments"><article class="comment"><p>{text}</p></article></div>') == ""


def seconds(run, *args) -> float:
    best = float("inf")
    for _ in range(3):
        start = time.perf_counter()
        run(*args)
        best = min(best, time.perf_counter() - start)
    return best


@pytest.mark.parametrize(
    "make, run",
    [
        (lambda n: "x at y " + "a dot " * n, lambda t: pii.all_spans(t, pii.plain_spans(t))),
        (lambda n: "x at y" + " dot y" * n, lambda t: pii.all_spans(t, pii.plain_spans(t))),
        (lambda n: "a [at] b.com, " * n, lambda t: pii.all_spans(t, pii.plain_spans(t))),
        (lambda n: "<div>a" * n, main_text.blocks_of),
        (lambda n: "<div>a" * n, lambda t: main_text.edges_of(main_text.blocks_of(t))),
    ],
)
def test_time_grows_with_the_text(make, run):
    """Eight times the text takes far less than 64 times the time."""
    small, large = seconds(run, make(2_000)), seconds(run, make(16_000))
    assert large < 24 * max(small, 0.002)


def test_bare_addresses_equal_the_pattern():
    tops = "com|org|net|edu|gov|io|co|info|de|fr|es|uk|eu|us"
    pattern = re.compile(
        r"(?i)(?<![a-z0-9._%+-])[a-z0-9_%+-]+(?: dot [a-z0-9_-]+)* at [a-z0-9-]+(?: dot [a-z0-9-]+)*? dot "
        rf"(?:{tops})(?![a-z0-9])"
    )
    rng = np.random.default_rng(4)
    words = ["a", "b-c", "x.y", "dot", "com", "Dot", "(jo", "de,", "io", "q_1", "", "dot", "dot"]
    for _ in range(20_000):  # the word "at" itself is no part of a name or host
        left, right = (list(rng.choice(words, int(rng.integers(1, 7)))) for _ in range(2))
        text = " ".join([*left, str(rng.choice(["at", "AT"])), *right])
        assert pii.bare_addresses(text) == [m.span() for m in pattern.finditer(text)], text


def test_digit_words_of_four_languages():
    for line in pii._DIGITS:
        digits = line.split()
        text = "call " + " ".join(digits[int(d)] for d in "4111111111111111") + " now"
        shown = pii.all_spans(text, pii.plain_spans(text))
        assert [text[a:b] for a, b in shown["card"]] == [text[5:-4]]


def test_main_text(spark):
    ship_code(spark)
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site name</header>
    <nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <div id=x><h1>Big   title</h1><p>First <b>bold</b> paragraph with enough words to be read as such &amp; more.<br>Line
    <p>Second paragraph, again with quite a few words in it for a reader.</p>
    <script>var t="</p>";</script></div><aside>See also</aside><form>Mail <input></form>
    <section class="comments"><p>A reader says that this is a long and thoughtful comment on it.</p></section>
    <footer>&copy; Us</footer></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>open <b>tags<div class=ad>x"), (5, "u", "a" * 100_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in main_text.extract(table).collect()}
    assert found[1].text == (
        "Big title First bold paragraph with enough words to be read as such & more. Line"
        " Second paragraph, again with quite a few words in it for a reader."
    )
    assert found[2].text == "" == found[3].text and found[4].text == "open tags" and found[5].n_chars == 100_000
    assert main_text.extract(table.where("false")).count() == 0


def test_minimum_cut_against_all_labellings():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 9))
        content, boilerplate = list(rng.random(n)), list(rng.random(n))
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def price(bits):
            own = sum(boilerplate[i] if bits >> i & 1 else content[i] for i in range(n))
            return own + sum(w for i, j, w in edges if (bits >> i & 1) != (bits >> j & 1))

        chosen = main_text.minimum_cut(content, boilerplate, edges)
        assert price(sum(1 << i for i, c in enumerate(chosen) if c)) == pytest.approx(min(map(price, range(1 << n))))


def test_personal_data(spark, docs, nothing):
    ship_code(spark)
    text = "Mail a.b@c.de, 10.0.0.256 10.0.0.1 card 4111 1111 1111 1111 call +1 (212) 555-0100."
    base = pii.plain_spans(text)
    assert {k: [text[a:b] for a, b in v] for k, v in base.items()} == {
        "email": ["a.b@c.de"], "ip": ["10.0.0.1"], "card": ["4111 1111 1111 1111"], "phone": ["+1 (212) 555-0100"],
    }
    hidden = "to jane dot doe at mail dot example dot com or x [at] y.org, pаul@site.com, four one one one 1111 1111 one one one one"
    shown = {k: [hidden[a:b] for a, b in v] for k, v in pii.all_spans(hidden, pii.plain_spans(hidden)).items()}
    assert "jane dot doe at mail dot example dot com" in shown["email"] and "x [at] y.org" in shown["email"]
    assert shown["card"] == ["four one one one 1111 1111 one one one one"]
    clean = "look at this dot, one two three"
    assert pii.all_spans(clean, pii.plain_spans(clean)) == {k: [] for k in pii.KINDS}
    found = pii.find_personal_data(docs).collect()
    assert len(found) == 11 and all(r.spans == "" for r in found) and pii.find_personal_data(nothing).count() == 0


def test_plain_spans_equal_the_bare_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = np.random.default_rng(2)
    for _ in range(4_000):
        text = "".join(rng.choice(list("a1.@- 25"), int(rng.integers(0, 30))))
        assert pii.emails(text) == [m.span() for m in email.finditer(text)]
        assert pii.ips(text) == [m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]


def test_permutation_index(spark, sf_dir):
    ship_code(spark)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    ids = np.array(sorted(rows))
    units = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    found = ann.nearest(table).collect()
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        score = units @ units[np.searchsorted(ids, q)]
        order = [ids[i] for i in np.lexsort((ids, -score)) if ids[i] != q][:5]
        hits += len(set(order) & {r.vec_id for r in found if r.query_id == q})
        total += 5
    assert hits >= 0.9 * total
    assert all(abs(r.score - units[np.searchsorted(ids, r.query_id)] @ units[np.searchsorted(ids, r.vec_id)]) < 1e-12 for r in found)


def test_footrule_against_plain_sums():
    rng = np.random.default_rng(6)
    orders = np.stack([rng.permutation(30)[:8] for _ in range(50)])
    query = rng.permutation(30)[:8]
    places = ann._places(orders, 30)
    for order, got in zip(orders, ann._footrule(query, places), strict=True):
        at = {p: i for i, p in enumerate(order)}
        assert got == sum(abs(at.get(p, 8) - i) for i, p in enumerate(query))


def test_permutation_index_ranks_by_footrule_at_any_size(spark, sf_dir):
    """A smaller share of each file finds less, so the footrule decides in small tables as well."""
    ship_code(spark)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    whole, some = (ann.nearest(table, reranked=r).agg({"score": "sum"}).first()[0] for r in (1.0, 0.1))
    assert some < whole


def test_permutation_index_odd_rows(spark):
    ship_code(spark)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [0.0, 3.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, None)]
    rows += [(9, [1.0, None]), (100, [0.0, 0.0]), (12, [1.0, 2.0, 3.0]), (7, [2.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.nearest(table).collect()]
    assert sorted(found) == [(0, 1, 7, 1.0), (0, 2, 50, 1.0), (0, 3, 8, 0.0), (50, 1, 0, 1.0), (50, 2, 7, 1.0), (50, 3, 8, 0.0)]
    assert ann.nearest(table.where("false")).count() == 0


def test_token_rollup(spark, docs, nothing, tmp_path):
    ship_code(spark)
    vocabularies = {"bpe": packing.public_vocabulary()}
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    for _ in range(2):  # the second commit of a batch changes nothing
        rollup.commit("b0", token_counts.delta(token_counts.counted(docs, vocabularies), 1))
    got = {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in rollup.totals().collect()}
    assert got[("a", "en", "words")] == (4, 60 + 60 + 5 + 30_000) and got[(None, "de", "words")] == (1, 0)
    old, new = docs.where("doc_id = 7"), docs.where("doc_id = 7").withColumn("text", docs["lang"])
    rollup.revise("b1", token_counts.counted(old, vocabularies), token_counts.counted(new, vocabularies))
    got = {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in rollup.totals().collect()}
    assert got[("c", "fr", "words")] == (3, 4)
    rollup.commit("b2", token_counts.delta(token_counts.counted(docs.where("source = 'b'"), vocabularies), -1))
    rollup.commit("b3", token_counts.delta(token_counts.counted(nothing, vocabularies), 1))
    before = sorted(map(str, rollup.totals().collect()))
    rollup.compact()
    rollup.commit("b1", token_counts.delta(token_counts.counted(docs, vocabularies), 1))  # known from before
    assert sorted(map(str, rollup.totals().collect())) == before and rollup.table.batches() == ["b0", "b1", "b2", "b3"]
    assert "b" not in {r.source for r in rollup.totals().collect()}


def test_word_table_is_small_and_ids_do_not_depend_on_it():
    """A worker keeps 65,536 words at most; words beyond are encoded each time, with the same ids."""
    from array import array

    from feedback_engine.llm import bpe, packing

    vocabulary = packing.public_vocabulary()
    coder = bpe.Bpe(vocabulary.ranks_path, vocabulary.pattern)
    digits = str.maketrans("0123456789", "abcdefghij")
    text = " ".join(str(i).translate(digits) for i in range(70_000))
    want = array("I", coder.coding.encode_ordinary(text)).tobytes()
    assert coder.ids(text) == want and len(coder.words) <= 1 << 16
    assert coder.ids(text) == want
