"""The methods against plain versions of themselves, held-out figures, and hot, clashing or foreign keys."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, language_id, license_scan, near_dedup, packing, quality, queries, secret_scan, sp_codec, toxicity, url_filters
from quillspark.llm.common import share_of, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# ---- 1


def test_secrets_by_kind(docs):
    """Kinds that no pattern describes, planted anew: recall by kind, and harmless runs left alone."""
    network = secret_scan.train(docs.select("doc_id", "text"))
    rows, labels, kinds = secret_scan.seeded_by_kind(2400, seed=1234)
    found, kinds = network.score(rows) >= network.threshold, np.array(kinds)
    recall = {k: found[kinds == k].mean() for k in secret_scan.UNPATTERNED}
    assert min(recall.values()) >= 0.9 and np.mean(list(recall.values())) >= 0.95, recall
    assert found[np.array(labels) == 0].mean() <= 0.06


def test_network_equals_plain_convolution():
    network, (rows, _) = secret_scan.Network.fresh(), secret_scan.seeded_findings(6)
    p = network.params
    for row, z in zip(rows, network.forward(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, secret_scan.WIDTH))[0], strict=True):
        e, h = p["emb"][list(row)], []
        for w in network.widths:
            act = [np.maximum(e[i : i + w].ravel() @ p[f"w{w}"] + p[f"b{w}"], 0) for i in range(len(row) - w + 1)]
            h += [np.max(act[: secret_scan.BEFORE], 0), np.max(act[secret_scan.BEFORE :], 0)]
        assert abs(float(np.concatenate(h) @ p["out"] + p["bias"][0]) - z) < 1e-4


# ---- 2


def test_pieces_with_equal_or_no_ids_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_TASK", 500)
    docs = spark.createDataFrame([(None, f"word {i % 7}") for i in range(4000)], "doc_id long, text string")
    out = packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json"))
    tasks = Counter(r.task for r in out.select((F.col("sequence_id").bitwiseAND(~((1 << 33) - 1))).alias("task")).collect())
    assert sum(tasks.values()) == 4000 and len(tasks) == 8 and max(tasks.values()) < 800


def test_packing_is_the_same_in_any_order(spark, docs):
    path = queries.vocabulary("word_bpe_49k.json")
    place = lambda d: sorted((r.doc_id, r.piece, r.sequence_id & ((1 << 33) - 1), r.offset) for r in packing.pack_documents(d, path).collect())
    assert place(docs) == place(docs.orderBy(F.desc("text")).repartition(3))


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    tok = Tokenizer(WordLevel({"[UNK]": 0, "a": 1, "b": 2, ".": 3}, unk_token="[UNK]"))
    tok.pre_tokenizer = Whitespace()
    assert not packing.words_stand_alone(tok) and packing.words_stand_alone(packing.tokenizer(queries.vocabulary("word_bpe_49k.json")))
    got = packing.WordEncoder(tok).encode(pa.array(["a b.", None, "c  a"]))
    assert [x.tolist() for x in got] == [[1, 2, 3], [], [0, 1]]


# ---- 3


def test_profiles_equal_a_direct_sum(texts):
    for text in [*list(texts.values())[:5], "Привет мир", "日本語の文", "Ünïcödé"]:
        symbols, total = [0], np.zeros(language_id.DIMENSIONS)
        for c in text.lower():
            symbols += [ord(c)] if c.isalpha() else [0] * (symbols[-1] != 0)
        symbols += [0] * (symbols[-1] != 0)
        for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
            va, vb, vc = (language_id.letter(x, language_id.DIMENSIONS) for x in (a, b, c))
            total += np.roll(va, 2) * np.roll(vb, 1) * vc
        assert (language_id.bundle(*language_id.trigrams(text)) == total).all()


def test_letters_have_vectors_of_their_own():
    near = [abs(int(language_id.letter(a, 1024).astype(int) @ language_id.letter(b, 1024))) for a in (ord("ж"), ord("α"), 0x4E2D) for b in (ord("a"), ord("ш"), ord("ω"), 0x56FD)]
    assert max(near) < 160


def test_other_scripts_are_told_apart(spark):
    ru, bg = ["что это за дом и где он стоит", "мы не знаем как это было вчера"] * 20, ["това е къщата която видях вчера", "аз не зная къде е той сега"] * 20
    rows = [(i, t, "ru") for i, t in enumerate(ru)] + [(100 + i, t, "bg") for i, t in enumerate(bg)]
    got = language_id.train_and_identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == ("ru" if r.doc_id < 100 else "bg") for r in got)


def test_shares_keep_their_size(spark):
    ids = spark.range(200_000).withColumnRenamed("id", "doc_id")
    assert ids.filter(share_of("doc_id", 1.0)).count() == 200_000
    assert 150 < ids.filter(share_of("doc_id", 0.001)).count() < 250
    assert ids.filter(share_of("doc_id", 1e-9)).count() == 0


# ---- 5


def test_spans_of_the_query(spark, texts):
    """Brute force: each piece is looked for in the normalised text from where the last one ended; spaces are three bytes there."""
    sp = sp_codec.processor(queries.vocabulary("piece_bpe_32k.model"))
    for r in queries.QUERIES["op5_sentencepiece"](spark, SF).collect():
        data, starts, ends = texts[r.doc_id].encode(), [], []
        source = [0] * 3 * bool(data)
        i = 0
        while i < len(data):
            width = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
            source += [i] * (3 if data[i] == 32 else width)
            i += width
        source.append(len(data))
        at = 0
        for piece in sp.encode(texts[r.doc_id]):
            starts.append(source[at])
            at += 1 if sp.is_byte(piece) else len(sp.id_to_piece(piece).encode())
            ends.append(source[at])
        assert r.spans_crc32 == zlib.crc32(np.array([starts, ends], "<i8").tobytes())


# ---- 6


def test_scores_equal_a_plain_forward_pass(texts):
    some = [t for t in texts.values() if len(t) < 600][:6] + ["", "one", "two words", "", "x"]
    model = toxicity.Classifier.fresh()
    at, codes, buckets = toxicity.encoded(pa.array(some))
    for text, z in zip(some, model.logits(at, codes, buckets), strict=True):
        e = [model.table[b].sum(0) for b in toxicity.word_codes(text.replace("\n", " ").split(" "))]
        h = []
        for w in toxicity.WIDTHS:
            padded = e + [np.zeros(toxicity.SIZE, np.float32)] * (w - 1) * (len(e) < w)  # a text shorter than the filter ends in zeros
            act = [sum(padded[i + j] @ model.filters[w][j] for j in range(w)) + model.bias[w] for i in range(len(padded) - w + 1)]
            h.append(np.maximum(np.max(act, 0), 0))
        assert abs(float(np.concatenate(h) @ model.out) + model.offset - z) < 1e-3


def test_held_out_toxic_documents(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    got = [(r.predicted, toxic[r.doc_id]) for r in queries.QUERIES["op6_toxicity"](spark, sf).filter("held_out").collect() if r.doc_id in toxic]
    assert np.mean([p for p, t in got if t]) >= 0.9 and np.mean([p for p, t in got if not t]) <= 0.02


# ---- 7


def test_licenses_equal_a_sliding_alignment(texts):
    """Every stretch of a template's length in which a longest common subsequence covers enough overlaps a finding; short templates."""
    some = [license_scan.template(n, t, license_scan.COVERAGE) for n, t in license_scan.TEMPLATES.items() if len(t) < 90]
    for text in texts.values():
        words, spans = license_scan.words_of(text)
        present, found = set(words), None
        for t in some:
            m = len(t.words)
            if len(set(t.words) & present) < 2:
                continue
            for i in range(max(1, len(words) - m + 1)):
                if license_scan.common_length(t.words, words[i : i + m]) >= t.need:
                    found = license_scan.scan(text) if found is None else found
                    assert any(f["start"] < spans[min(i + m, len(words)) - 1][1] and f["end"] > spans[i][0] for f in found), (t.name, words[i : i + m])


# ---- 8


def test_histograms_and_verdicts(spark, docs, texts):
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    classes, words, n_docs = {}, {}, Counter(lang.values())
    for i, t in texts.items():
        c = classes.setdefault(lang[i], Counter())
        for ch in t:
            kind = "lower" if "a" <= ch <= "z" else "upper" if "A" <= ch <= "Z" else "digit" if "0" <= ch <= "9" else "line" if ch == "\n" else "space" if ch in " \t\r\x0b\x0c" else "stop" if ch in ".,;:!?'\"()-" else "symbol" if ch in "#*$%&|<>" else "wide" if ord(ch) > 127 else "other"
            c[kind] += 1
        words.setdefault(lang[i], Counter()).update(t.encode().lower().split())
    good = [x for x in sorted(filter(None, n_docs)) if n_docs[x] >= quality.REFERENCE_DOCS and words[x].total() >= quality.REFERENCE_WORDS]
    refs = quality.references(docs)
    assert refs.langs == good
    for k, x in enumerate(good):
        assert np.allclose(refs.chars[k], [classes[x][c] / classes[x].total() for c in quality.CLASSES])
        common = {w: n / words[x].total() for w, n in words[x].items() if n / words[x].total() >= quality.COMMON_SHARE}
        assert {w: round(refs.common[k, i], 9) for w, i in refs.words.items() if refs.common[k, i]} == {w: round(n, 9) for w, n in common.items()}
    got = queries.QUERIES["op8_quality_rules"](spark, SF).collect()
    alike = {}
    length = lambda r: int(math.log2(max(1, r.n_words)))
    for r in got:
        if r.nearest is not None:
            assert math.isclose(r.char_distance, math.sqrt(max(0, r.char_divergence))) and math.isclose(r.word_distance, math.sqrt(max(0, r.word_divergence)))
            if not r.base_failed and not r.is_foreign:
                alike.setdefault((r.nearest, length(r)), []).append(r)
                alike.setdefault(length(r), []).append(r)

    def fence(same, kind):
        ordered = sorted(math.ceil(getattr(x, kind) * quality.BINS) / quality.BINS for x in same)
        low, middle, high = (ordered[max(0, math.ceil(q * len(ordered)) - 1)] for q in (0.25, 0.5, 0.75))
        return max(high + quality.FENCE * (high - low), 2 * middle)

    for r in got:
        limits = []
        for kind, most in (("char_distance", quality.MAX_CHAR_DIVERGENCE), ("word_distance", quality.MAX_WORD_DIVERGENCE)):
            same, near = alike.get((r.nearest, length(r)), []), alike.get(length(r), [])
            limits.append(fence(same, kind) if len(same) >= quality.REFERENCE_DOCS else max([most**0.5, *([fence(near, kind)] if len(near) >= quality.REFERENCE_DOCS else [])]))
        far = r.nearest is not None and ((r.word_chars >= quality.MIN_CHARS and r.char_distance > limits[0]) or (r.n_words >= quality.MIN_WORDS and r.word_distance > limits[1]))
        if r.is_foreign:
            far = r.word_chars >= quality.MIN_CHARS and r.shape_divergence > quality.MAX_SHAPE_DIVERGENCE
        assert r.kept == (not r.base_failed and not far)


@pytest.mark.parametrize("n", [15, 24, 40])
def test_rare_languages_live(spark, docs, n):
    """Documents of a language of their own stay, however few they are; junk in it doesn't. Few of them are no reference."""
    import random

    rng = random.Random(n)
    word = lambda: "".join(rng.choice("абвгдежзиклмнопрстуфхцчшя") for _ in range(rng.randint(2, 9)))
    common = [word() for _ in range(30)]

    def prose(k):
        words = [rng.choice(common) if rng.random() < 0.4 else word() for _ in range(k)]
        return " ".join(w.capitalize() + "," if i % 11 == 0 else w + "." * (i % 9 == 8) for i, w in enumerate(words))

    good = [prose(rng.choice([25, 60, 200, 900])) for _ in range(n)]
    junk = [" ".join(w + "###" for w in prose(150).split()), " | ".join(prose(150).split()), "1234 567 89 " * 80, "".join(f"<{w}> {i} | %% " for i, w in enumerate(prose(120).split()))]
    rows = [(10_000_000 + i, t, "ru") for i, t in enumerate(good + junk)]
    every = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = {r.doc_id - 10_000_000: r.kept for r in quality.quality_rules(every).filter("doc_id >= 10000000").collect()}
    assert [i for i in range(n) if not kept[i]] == [] and not any(kept[n + i] for i in range(len(junk)))


# ---- 9


def test_list_keys_are_folded(spark):
    captures = spark.createDataFrame([(1, "http://B.com./x"), (2, "http://x.b.com/"), (3, "http://10.0.0.1/"), (4, "http://c.com/")], "page_id long, url string").withColumn("fetched", F.lit("2024-02-01").cast("date"))
    entries = spark.createDataFrame([("B.com.", "BLOCK"), ("0.1", "block"), ("c.com", "deny"), ("c.com", "block"), ("", "block")], "list_key string, action string").withColumn("since", F.lit("2024-01-01").cast("date"))
    got = {r.page_id: (r.host, r.list_key, r.kept) for r in url_filters.filter_urls(captures, entries).collect()}
    assert got == {1: ("b.com", "b.com", False), 2: ("x.b.com", "b.com", False), 3: ("10.0.0.1", None, True), 4: ("c.com", "c.com", False)}


# ---- 10


def test_ids_that_repeat_or_are_text(spark):
    one, two, far = "a b c d e f g h i j k l m n", "a b c d e f g h i j k l m n", "q w e r t y u i o p"
    rows = [("x", one), ("y", two), ("x", far), (None, one), ("z", far), ("w", None)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id string, text string"), 3, 85).collect()
    assert sorted((r.doc_id or "", r.n_shingles, r.component_id or "", r.kept) for r in got) == sorted([("x", 12, "x", True), ("y", 12, "x", False), ("x", 8, "x", True), ("", 12, "", True), ("z", 8, "x", False), ("w", 0, "w", True)])
    rows = [(1, one), (2, two), (1, far), (3, far)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 8, 1), (1, 12, 1), (2, 12, 1), (3, 8, 1)]


def test_size_classes_keep_linked_sets_near():
    for percent in (80, 85):
        base = 1.000001 * math.log(100 / percent)
        for n in range(1, 3000):
            m = math.ceil(n * percent / 100)
            assert abs(math.floor(math.log(n) / base) - math.floor(math.log(m) / base)) <= 1


@pytest.mark.parametrize("op", ["secrets", "licenses", "languages", "quality", "codec", "packing", "exact"])
def test_text_ids_stay(spark, op):
    docs = spark.createDataFrame([("a1", "some words here", "en"), ("b2", "some more words here", "en"), (None, None, None)], "doc_id string, text string, lang string")
    run = {
        "secrets": secret_scan.scan_secrets,
        "licenses": license_scan.scan_licenses,
        "languages": language_id.train_and_identify,
        "quality": quality.quality_rules,
        "codec": lambda d: sp_codec.encode_documents(d, queries.vocabulary("piece_bpe_32k.model")),
        "packing": lambda d: packing.pack_documents(d, queries.vocabulary("word_bpe_49k.json")),
        "exact": exact_dedup.exact_dedup,
    }[op]
    assert {r.doc_id for r in run(docs).select("doc_id").collect()} == {"a1", "b2", None}


def test_defined_cases(spark):
    """Null and empty texts, a very long word, repeated rows and extra columns, by value."""
    long = "y" * 30_000
    rows = [(1, None, "a"), (2, "", "b"), (3, long, "c"), (4, "same words", "d"), (4, "same words", "d"), (5, "password=abcdefgh12345 é", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, findings string").withColumn("licenses", F.lit(1)).withColumn("piece", F.lit("p"))
    sp = sp_codec.processor(queries.vocabulary("piece_bpe_32k.model"))
    for r in sp_codec.encode_documents(docs, queries.vocabulary("piece_bpe_32k.model")).collect():
        text = {i: t or "" for i, t, _ in rows}[r.doc_id]
        assert r.ids == sp.encode(text, add_eos=True) and r.decoded == sp.decode(r.ids) and len(r.starts) == len(r.ends) == len(r.ids) - 1
        assert (r.ids == [sp.eos_id()]) == (text == "")
    found = sorted((r.doc_id, [(f.kind, f.start, f.end) for f in r.findings if f.kind != "model"]) for r in secret_scan.scan_secrets(docs).collect())
    assert found == [(1, []), (2, []), (3, []), (4, []), (4, []), (5, [("assign", 0, 22)])]
    assert [(r.doc_id, r.licenses) for r in license_scan.scan_licenses(docs).orderBy("doc_id").collect()] == [(i, []) for i, _, _ in rows]
    placed = packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id, r.length) for r in placed if r.doc_id in (1, 2, 4))[:2] == [(1, 1), (2, 1)]
    same = [r for r in placed if r.doc_id == 4]
    assert len(same) == 2 and same[0].ids_crc32 == same[1].ids_crc32 and (same[0].sequence_id, same[0].offset) != (same[1].sequence_id, same[1].offset)


# ---- 1, again


def test_a_repeated_window_is_sampled_like_others(spark):
    """One line in 20 000 documents: no more windows than the bound are collected, and the network still learns."""
    line = "The same notice stands in every one of them: internationalization_of_notices and no more."
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(line).alias("text"))
    found = secret_scan.sample(docs)
    assert 0.8 * secret_scan.SAMPLE_FINDINGS < len(found) <= secret_scan.SAMPLE_FINDINGS
    few = secret_scan.sample(docs, findings=100)
    assert 50 < len(few) <= 100 and len({w for w, _ in few}) == 1
    network = secret_scan.train(docs)
    rows, labels, kinds = secret_scan.seeded_by_kind(600, seed=77)
    assert (network.score(rows) >= network.threshold)[np.isin(kinds, secret_scan.UNPATTERNED)].mean() >= 0.9


def test_planted_secrets_that_the_generator_does_not_make(spark, docs):
    """Other kinds in other surroundings, one in each of 200 whole held-out documents: recall, and precision over all that is added."""
    import random

    rng = random.Random(17)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = {
        "google": lambda: ("const mapsKey(", "AIza" + pick(low + up + num + "_-", 35), ");"),
        "mailer": lambda: ("X-Smtp-Auth ", "SG." + pick(low + up + num, 22) + "." + pick(low + up + num + "_-", 43), "\n"),
        "live": lambda: ("<charge using='", "rk_live_" + pick(low + up + num, 24), "'/>"),
        "account": lambda: ("AccountKey=", pick(low + up + num + "+/", 86) + "==", ";EndpointSuffix"),
        "hook": lambda: ("POST https://hooks.example.com/services/", "T" + pick(up + num, 8) + "/B" + pick(up + num, 8) + "/" + pick(low + up + num, 24), " every hour"),
        "signed": lambda: ("&Signature=", pick(low + up + num, 40), "&Expires"),
    }
    network = secret_scan.train(docs.select("doc_id", "text").filter("doc_id % 2 = 1"))
    held = [r.text for r in docs.filter("doc_id % 2 = 0").orderBy("doc_id").collect()] * 2
    rows, where = [], {}
    for i, text in enumerate(held):
        kind = list(kinds)[i % len(kinds)]
        lead, secret, tail = kinds[kind]()
        at = text.find(" ", len(text) // 2) + 1
        rows.append((i, text[:at] + lead + secret + tail + " " + text[at:]))
        where[i] = (kind, at + len(lead), at + len(lead) + len(secret))
    hits, added, right = Counter(), 0, 0
    for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), network).collect():
        kind, a, b = where[r.doc_id]
        inside = [f for f in r.findings if f.start < b and f.end > a]
        hits[kind] += any(min(f.end, b) - max(f.start, a) >= 0.8 * (b - a) for f in inside)
        model = [f for f in r.findings if f.kind == "model"]
        added += len(model)
        right += sum(f in inside for f in model)
    total = Counter(kind for kind, _, _ in where.values())
    recall = {k: round(hits[k] / total[k], 3) for k in kinds}
    print("recall", recall, "precision", round(right / max(1, added), 3), added)
    # the only words taken for secrets are the joined-up ones planted next to one kind (EndpointSuffix)
    assert sum(hits.values()) / sum(total.values()) >= 0.9 and right / added >= 0.85


def test_pieces_that_do_not_tile_lose_no_job(spark, monkeypatch):
    """A document whose pieces don't spell its normalised text keeps ids and text; its spans are null."""
    docs = spark.createDataFrame([(1, "some words"), (2, "odd one"), (3, "more words")], "doc_id long, text string")
    path = queries.vocabulary("piece_bpe_32k.model")
    codec = sp_codec.Codec(path)
    assert codec.spans("some words", np.array(codec.sp.encode("some other words"))) is None
    keep = sp_codec.Codec.spans
    monkeypatch.setattr(sp_codec.Codec, "spans", lambda self, text, ids: None if text == "odd one" else keep(self, text, ids))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3]), "text": pa.array(["some words", "odd one", "more words"])})
    for digest in (False, True):
        (out,) = sp_codec.encode_batches(iter([batch]), path, digest)
        rows = out.to_pylist()
        assert [r["spans_crc32" if digest else "starts"] is None for r in rows] == [False, True, False]
        assert [r["n_tokens"] if digest else len(r["ids"]) for r in rows] == [len(codec.sp.encode(t)) + 1 for t in ("some words", "odd one", "more words")]
    assert sp_codec.encode_documents(docs, path).count() == 3
