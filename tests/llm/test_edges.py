"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names, for every operator."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.llm import audio, chat, lines, mixing, packing, pseudonyms, sketches, toxicity, vectors, webpages
from rillstone.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, k long, taken string"
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 5, 1, 1, "x"),
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 5, 1, 1, "x"),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, 0, 0, ""),
    (None, "alpha beta gamma delta epsilon zeta", None, None, None, None, None, None),
    (4, "one\ntwo\nthree\nfour " + "word " * 5000, "en", "b", 1, 1, 1, "y"),
    (5, "zero\none\ntwo\nthree\n\nend, mail a.b@c.example +1 (017) 555-7713", "en", "b", 1, 1, 1, "y"),
]


@pytest.fixture(params=["rows", "empty"])
def docs(spark, request):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], DOCS)


def test_documents_operators_take_anything(spark, docs):
    n = docs.count()
    pieces = packing.pack_documents(docs).collect()
    assert {p.doc_id for p in pieces} == ({1, 2, 3, 4, 5, None} if n else set())
    near = sketches.near_duplicates(docs, 3, (85, 100)).collect()
    assert len(near) == n
    assert all(r.component_id == 1 for r in near if r.n_shingles == 4)
    kept = sketches.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == (5 if n else 0)
    assert audio.read_media(audio.store_texts(docs)).count() == n
    cleaned = lines.drop_repeated_lines(docs)
    assert cleaned.columns == docs.columns
    assert cleaned.count() == n
    if n:
        assert cleaned.filter("doc_id = 5").first().text.startswith("zero\n\nend")  # the run one, two, three stands in 4 already
    hidden = pseudonyms.pseudonymise(docs, "k", counts=True)
    assert hidden.count() == n
    if n:
        assert "555-7713" not in hidden.filter("doc_id = 5").first().text
    labels = spark.createDataFrame([(1, 1, None), (4, None, 1), (5, 0, 0)] if n else [], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == n
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert (mixed.count() > 0) == bool(n)


def test_mix_budget(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", "abc"[i % 3] if i % 10 else None, 0, 0, 0, "") for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.takes(mixing.keyed_documents(docs), range_rows=16).collect()
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    for rs in by.values():
        assert sum(r.taken for r in rs) == round(rs[0].target)
    assert mixing.mix(docs).select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r.taken for r in out)


def test_chat(spark):
    rows = [(1, 1, "user", "a\\<|im_end|>\n<"), (1, 2, "user", None), (1, 3, "assistant", "<|x"), (1, 3, "assistant", "<|x"), (2, None, None, ""), (None, 0, "assistant", "z")]
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1].n_turns == 4
    assert got[1].loss_chars == 6
    assert got[1].turns_sha256 == hashlib.sha256("user\na\\<|im_end|>\n<\nuser\n\nassistant\n<|x\nassistant\n<|x\n".encode()).hexdigest()
    assert got[2].loss_chars == 0
    assert set(got) == {1, 2, None}


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    edges = [(1, 2), (2, 3), (7, 3), (9, 8), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 8, 9: 8, 5: 5}


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 8))
    x = np.vstack([base, base[:30] + 0.05 * rng.normal(size=(30, 8)), base[:5]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [1.0, None]), (204, []), (205, [1.0, 2.0]), (None, x[0].tolist())]
    got = {r.vec_id: r for r in vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.95, 10, 8).collect()}
    u = np.vstack([x, x[:1]]).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    a = u @ u.T >= 0.95
    assert [got[i].n_links for i in range(len(x))] == (a.sum(1) - 1)[: len(x)].tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (200, 201, 202, 203, 204, 205))
    assert vectors.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pages(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p><b>x\n y<br>z<p>second</p><aside>no</aside><div id='comments'>rude</div><script>var a='<p>';</script></article><footer>f</footer>"
    assert webpages.main_text(page) == "A & B\n\nx y z\n\nsecond"
    rows = [(i, "http://h.example/1", f"<body><p>text {i}</p><p>Join our list</p></body>") for i in range(10)] + [(20, None, None), (21, "x", "")]
    got = {r.page_id: r.text for r in webpages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "text 3"
    assert got[20] == got[21] == ""


def test_pages_that_copy_each_other(spark):
    text = "<body><div class='x'>Join our list</div><article><h1>Head</h1><p>the same text</p></article></body>"
    rows = [(i, "http://h.example/1", text) for i in range(10)] + [(i, "http://h.example/2", f"<body><p>text {i}</p></body>") for i in range(10, 20)]
    rows += [(i, "http://one.example/", text.replace("Join", f"{i} join")) for i in range(20, 30)]
    got = {r.page_id: r.text for r in webpages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in (*range(10), *range(20, 30))} == {"Head\n\nthe same text"}
    assert got[12] == "text 12"


def test_media_round_trip():
    for n in (64, 1408, 1472, 100_032):
        payload = bytes(i * 7 % 256 for i in range(n))
        media = audio.store(payload)
        s = audio.parse(media)
        assert audio.payload_of(media, s) == payload
        assert s.vbr["frames"] == len(s.offsets) == s.checked
        assert s.damaged == 0
    hurt = bytearray(media)
    hurt[3000:3010] = b"\0" * 10
    assert audio.parse(b"noise" + bytes(media)).skipped == 5 + s.head  # behind noise a tag is noise too
    assert len(audio.parse(bytes(hurt)).offsets) >= len(s.offsets) - 2


def test_near_duplicates_in_chunks(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        w = list(words)
        for j in rng.choice(120, rng.integers(0, 6), replace=False):
            w[j] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(118)} for i, t in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in sketches.near_duplicates(docs, 3, (85, 100), chunk=8).collect()} == root


def test_pseudonyms_undo(spark):
    text = "4111 1111 1111 1111 and 4845168114407329, 10.0.0.255, 999.1.1.1, 2020-02-29, 2021-02-29, 31.12.1999, 123-45-6789, +1 (017) 555-7713"
    df = spark.createDataFrame([(text,)], "text string")
    new = pseudonyms.pseudonymise(df, "k")
    got = new.first().text
    assert "999.1.1.1" in got and "2021-02-29" in got and "4111" not in got
    assert pseudonyms.pseudonymise(new, "k", undo=True).first().text == text


def test_pseudonyms_beside_other_numbers(spark):
    card = "4111 1111 1111 1111"
    texts = [f"{card} 12/27", "4111111111111111 05/2027", f"{card} 123", f"12 {card}", f"{card} 3782 822463 10005", f"{card} 2020-01-02 a", "31/12/1999", "+49 30 1234567", "+44 20 7946 0958", "4111 1111 1111 1112"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = pseudonyms.pseudonymise(df, "k", counts=True)
    got = {r.doc_id: r for r in new.collect()}
    alone = pseudonyms.pseudonymise(spark.createDataFrame([(card,)], "text string"), "k").first().text
    assert got[0].text == f"{alone} 12/27" and got[2].text == f"{alone} 123" and got[3].text == f"12 {alone}"
    assert got[1].text == alone.replace(" ", "") + " 05/2027"
    assert got[4].n_card == 2 and got[4].text.startswith(alone) and "822463" not in got[4].text
    assert (got[5].n_card, got[5].n_date) == (1, 1) and got[5].text.startswith(alone) and "2020-01-02" not in got[5].text
    assert got[6].n_date == 1 and int(got[6].text[:2]) > 12 and got[6].text != texts[6]
    for i, head in ((7, "+49 "), (8, "+44 ")):
        assert got[i].n_phone == 1 and got[i].text.startswith(head) and got[i].text != texts[i]
    assert got[9].text == texts[9]
    back = {r.doc_id: r.text for r in pseudonyms.pseudonymise(new.select("doc_id", "text"), "k", undo=True).collect()}
    assert [back[i] for i in range(len(texts))] == texts


def test_packing_ids(spark):
    from tokenizers import Tokenizer

    own, whole = packing.WordEncoder(packing.vocabulary_path()), Tokenizer.from_file(packing.vocabulary_path())
    for t in ("A'S 'S re've <|endoftext|> b. <|ENDOFTEXT|>,", "a!, b. c_, d., 3., x),\ny.", "é, É.\nx é. ́, Σας İ ß 😀😀\x85"):
        assert own.encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids
    lengths = np.sort(np.random.default_rng(3).integers(1, 4096, 500))[::-1]
    bins, offsets = packing.best_fit(lengths, 4096)
    for b in set(bins.tolist()):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offsets[at])]
        assert offsets[at].tolist() == [0, *np.cumsum(lengths[at])[:-1].tolist()]
        assert lengths[at].sum() <= 4096
    assert zlib.crc32(b"") == 0


def test_templates_decide_before_article_and_without_it(spark):
    """Menus and adverts filled anew for each page, without a telling tag or class, go by their shape; a notice within an article by its text."""
    links = lambda i: "".join(f"<li><a href='/{j}'>topic {i * 7 + j}</a></li>" for j in range(3 + i % 3))
    frame = lambda i, inner: f"<body><div class='q1'><ul>{links(i)}</ul></div><div class='q2'>buy number {i} now</div>{inner}<div class='q3'>page {i} of the site</div></body>"
    words = lambda i: " ".join(f"word{i}x{j}" for j in range(60 + i))
    plain = [(i, "http://a.example/", frame(i, f"<div class='c'><p>{words(i)}</p><ul><li>one {i}</li><li>two {i}</li></ul></div>")) for i in range(12)]
    article = [(i, "http://b.example/", frame(i, f"<article><p>{words(i)}</p><div class='z'>Read on in our shop</div></article>")) for i in range(12, 24)]
    few = [(i, "http://c.example/", frame(i, f"<div class='c'><p>{words(i)}</p></div>")) for i in range(24, 27)]
    pages = spark.createDataFrame(plain + article + few, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in webpages.extract(pages).collect()}
    off = {r.page_id: r.text for r in webpages.extract(pages, many=1000).collect()}
    for i in range(12):
        assert got[i] == f"{words(i)}\n\none {i}\n\ntwo {i}"
        assert f"buy number {i} now" in off[i]
    for i in range(12, 24):
        assert got[i] == words(i)
        assert off[i] == f"{words(i)}\n\nRead on in our shop"
    assert all(got[i] == off[i] for i in range(24, 27))


def test_templates_equal_a_count_by_hand(spark):
    """The whole of a table against counting in plain Python; templates alone, without any rule, delete nine tenths of what is not article text, and none of that."""
    import duckdb

    path = "/root/testdata/sf0.01/pages.parquet"
    rows = duckdb.sql(f"select page_id, regexp_extract(url, '://([^/?#:]*)', 1), html from '{path}'").fetchall()
    mains, seen, parts = {}, {}, {}
    for _, host, page in rows:
        main, found = webpages.subtree_hashes(page or "")
        mains.setdefault(host, set()).add(main)
        for h, part in found.items():
            seen.setdefault((host, h), set()).add(main)
            parts.setdefault((host, h), []).append(part)
    lists = {}
    for (host, h), pages in seen.items():
        if len(pages) >= max(webpages.MANY, webpages.SHARE * len(mains[host])) and sum(parts[host, h]) / len(parts[host, h]) <= webpages.PART:
            lists.setdefault(host, set()).add(h)
    want = {i: webpages.main_text(page, frozenset(lists.get(host, ()))) for i, host, page in rows}
    assert {r.page_id: r.text for r in webpages.extract(spark.read.parquet(path)).collect()} == want


def test_mix_of_repeated_rows(spark):
    """Equal rows are documents each for itself: twenty of ten words and a budget of 163 give 163 words."""
    rows = [(7, "w " * 10, "en", "a", 0, 0, 0, "")] * 20 + [(7, "v " * 10, "en", "a", 0, 0, 0, "")] * 3
    docs = spark.createDataFrame(rows, DOCS)
    share = 163 / 230
    assert mixing.mix(docs, share=share).select(F.sum(mixing.n_words(F.col("text")))).first()[0] == 163
    out = mixing.takes(mixing.keyed_documents(docs), share=share, range_rows=2).collect()
    assert sum(r.taken for r in out) == 163
    assert all(0 <= r.taken <= 10 for r in out)


def test_packing_over_several_rounds(spark):
    """Coverage, gapless offsets, the limit, and few more sequences than one global best-fit; lengths over half a sequence, which never join, end the rounds too."""
    for lengths in (np.random.default_rng(5).integers(1, 100, 3000), np.full(400, 60), np.asarray([1])):
        items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "item long, length long")
        got = packing.pack(items, 100, round_items=100).join(items, "item").collect()
        assert sorted(r.item for r in got) == list(range(len(lengths)))
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in by.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 100
        best = packing.best_fit(np.sort(lengths)[::-1], 100)[0].max() + 1
        assert len(by) <= best * 1.05 + 1  # leaves of a hundred items


def test_packing_documents_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    rows = [(i, "some plain words, and more. " * (i * 13 % 41)) for i in range(40)] + [(99, None), (99, "a" * 3000), (None, "x")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), sequence=64, round_items=8).collect()
    want = []
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, p, at, len(ids[at : at + 64]), zlib.crc32(np.asarray(ids[at : at + 64], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 64))]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1].tolist()]
        assert sum(n for _, n in parts) <= 64


def test_media_columns_against_the_bytes(spark):
    rows = [(i, "éx" * (i * 997)) for i in range(6)] + [(None, None)]
    for r in audio.read_media(audio.store_texts(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        raw = (dict(rows)[r.doc_id] or "").encode()
        body = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        assert r.sound and len(r.frame_offsets) * 1152 == r.duration_samples
    broken = spark.createDataFrame([(1, 0, b"no sound"), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [r.sound for r in audio.read_media(broken).collect()] == [False, False]


def test_many_copies_of_a_row(spark):
    """Fifty thousand copies of one row and a near copy: two classes, and no task that holds the texts of copies."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the very old house near a dark wood at night again"
    rows = spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(base).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(2, base + " today"), (3, "other words " + base[:20])], "doc_id long, text string"))
    got = {(r.doc_id, r.component_id, r.kept): r.n for r in sketches.near_duplicates(rows, 3, (85, 100)).groupBy("doc_id", "component_id", "kept").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, 1, True): 50_000, (2, 1, False): 1, (3, 3, True): 1}
    assert sorted(r.doc_id for r in sketches.drop_near_duplicates(rows, 3, (85, 100)).collect()) == [1, 3]
    cleaned = lines.drop_repeated_lines(spark.range(5_000).select("id", F.col("id").alias("doc_id"), F.concat(F.lit("a b\nc d\ne f\nown "), F.col("id").cast("string")).alias("text")))
    assert cleaned.filter("text = concat('own ', id)").count() == 4_999


def test_lines_by_themselves(spark):
    """A line of five words goes from ten places on, all but the first; nine places, four words and rows that copy a document do not make it recur."""
    notice, rare, short = "all rights of this text reserved", "this line stands at nine places", "read more about it"
    text = lambda i: f"own words of {i} here\n{notice}\nmore words of {i} there\n{rare if i < 9 else 'other'}\nlast words of {i} now\n{short}"
    docs = spark.createDataFrame([(i, text(i)) for i in range(10)] + [(0, text(0))] * 5, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(docs).collect()}
    assert got == {i: text(i).replace(notice + "\n", "") if i else text(0) for i in range(10)}
    few = docs.filter("doc_id < 9")
    assert {r.doc_id: r.text for r in lines.drop_repeated_lines(few).collect()} == {i: text(i) for i in range(9)}


def test_pipeline_stages_against_brute_force(spark):
    """The stages in a row on a small corpus, each held against a plain computation on its own input."""
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    # Toxicity: what stays is what scores below the cut, unchanged.
    scorer = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    one = cp.filter_toxic(spark, docs, d)
    own = toxicity.Scorer(*scorer.dictionaries).open() if scorer else None
    if own:
        own.weights = scorer.weights
    kept = {r.doc_id: r.text for r in one.collect()}
    assert kept == {i: t for i, t in texts.items() if own is None or own.score(t) < toxicity.CUT}
    # Line dedup: windows of three lines, or fewer that hold fifty words, seen earlier, and lines of five words or more at ten places; of longer lines the first and last fifty words seen earlier at an end.
    seen, gone, stands, ends, cuts = set(), {i: set() for i in kept}, {}, set(), {}
    for i in sorted(kept):
        ls = [(n, x.strip(" ")) for n, x in enumerate((kept[i] or "").split("\n")) if x.strip(" ")]
        for p in range(len(ls)):
            if 5 <= len(ls[p][1].split()) < 50:
                stands.setdefault(ls[p][1], []).append((i, ls[p][0]))
            words = re.findall(r"[^\x20\x09-\x0D]+", ls[p][1])
            for side, end in enumerate((words[:50], words[-50:]) if len(words) > 50 else ()):
                if tuple(end) in ends:
                    cuts.setdefault((i, ls[p][0]), [0, 0])[side] = 50
                ends.add(tuple(end))
            n, total = 3, 0
            for j in range(3):
                total += len(ls[p + j][1].split()) if p + j < len(ls) else 0
                if total >= 50:
                    n = j + 1
                    break
            if p + n <= len(ls):
                key = tuple(x for _, x in ls[p : p + n])
                if key in seen:
                    gone[i].update(m for m, _ in ls[p : p + n])
                seen.add(key)
    for places in stands.values():
        for i, m in places[1:] if len(places) >= 10 else []:
            gone[i].add(m)
    two = cp.dedup_lines(spark, one, d)
    cleaned = {r.doc_id: r.text for r in two.collect()}
    assert two.columns == columns

    def rest(x, lo, hi):
        spaced = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", x)
        return "".join(spaced[lo : max(lo, len(spaced) - hi)]).lstrip(" \t\n\x0b\x0c\r")

    assert cleaned == {i: t if t is None else "\n".join(rest(x, *cuts[i, n]) if (i, n) in cuts else x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in kept.items()}
    # Near duplicates: five-word shingles, 0.8.
    sets = {}
    for i, t in cleaned.items():
        w = sketches_words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by.values() for n, a in enumerate(ids) for b in ids[n + 1 :]}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while any(root[a] != root[b] for a, b in links):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    three = cp.dedup_near(spark, two, d)
    assert sorted(r.doc_id for r in three.collect()) == sorted(i for i in root if root[i] == i)
    # Mixing: words per source come to the targets.
    four = cp.mix_sources(spark, three, d)
    assert four.columns == columns
    count = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    sizes, mixed = count(three), count(four)
    names, weight = sorted(sizes), {n: (5, 2, 1)[i % 3] for i, n in enumerate(sorted(sizes))}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[n] for n in full)
        target = {n: 3 * sizes[n] if n in full else left * weight[n] / sum(weight[m] for m in names if m not in full) for n in names}
        over = {n for n in names if target[n] > 3 * sizes[n]}
        if not over:
            break
        full |= over
    assert all(abs(mixed[n] - target[n]) <= 1 for n in names)
    # Packing: all tokens of all rows.
    five = cp.pack_sequences(spark, four, d)
    encoder = packing.WordEncoder(packing.vocabulary_path())
    assert five.agg(F.sum("length")).first()[0] == sum(len(encoder.encode(r.text)) + 1 for r in four.collect())


def sketches_words(text):
    return text.encode().translate(sketches._LOWER).split() if text else []


def test_pseudonyms_of_dates_names_and_accounts(spark):
    """Dates of all years, mail names and account numbers are permuted within their form, and come back."""
    texts = ["1899-12-31", "2105-01-01", "0001-01-01", "9999-12-31", "30/12/0007", "31.01.9998", "Anna.B_7@mail.example.org", "a@b.cd", "GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000", "DE88370400440532013000"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = pseudonyms.pseudonymise(df, "k", counts=True)
    got = {r.doc_id: r for r in new.collect()}
    assert all(got[i].n_date == 1 and got[i].text != texts[i] and len(got[i].text) == 10 for i in range(6))
    assert got[6].text.endswith("@mail.example.org") and got[6].text != texts[6] and got[6].text[4] == "." and got[6].text[0].isupper()
    for i in (8, 9):
        x = got[i].text.replace(" ", "")
        assert got[i].n_iban == 1 and got[i].text != texts[i] and got[i].text[:2] == texts[i][:2] and len(got[i].text) == len(texts[i])
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert got[10].text == texts[10]
    assert {r.doc_id: r.text for r in pseudonyms.pseudonymise(new.select("doc_id", "text"), "k", undo=True).collect()} == dict(enumerate(texts))


def test_passages_at_the_ends_of_lines(spark):
    """A passage of 60 words behind, ahead of and between other words of three lines: the fifty words at an end go where they come later."""
    passage = " ".join(f"p{i}" for i in range(60))
    own = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, own("a", 9) + ". " + passage), (2, own("b", 70) + "\t " + passage + " "), (3, passage + " " + own("c", 3)), (4, passage + "; " + own("d", 4)), (5, own("e", 60)), (6, None), (7, " ".join(f"p{i}" for i in range(10, 60)))]
    out = {r.doc_id: r for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    assert out[1].text == rows[0][1]
    assert out[2].text == own("b", 70) + "\t " + " ".join(f"p{i}" for i in range(10))
    assert out[3].text == rows[2][1]
    assert out[4].text == " ".join(f"p{i}" for i in range(50, 59)) + " p59; " + own("d", 4)
    assert [out[i].text for i in (5, 6, 7)] == [rows[i][1] for i in (4, 5, 6)]
    assert all(r.n_removed == 0 for r in out.values())
