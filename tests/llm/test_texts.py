"""Token lattices, personal data, media, WARC and toxicity against the libraries and plain Python."""

import base64
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

from waylens.llm import media, pieces, pii, token_counts, toxicity, warc
from waylens.llm.queries import piece_model


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_model())


def some_texts(documents):
    rng = random.Random(6)
    made = ["".join(rng.choice("aabcethino rs  .-\n") for _ in range(200)) for _ in range(60)]
    return [r.text for r in documents.limit(60).collect()] + made + ["", "  ", "a\tb\r\n", "é ﬁ Ａ 日本​\x00", "<s> x</s>▁y", "a" * 700, "-=" * 90]


def test_ids_equal_the_library(documents, library):
    texts = some_texts(documents)
    own = pieces.Pieces(piece_model())
    assert [x.tolist() for x in own.encode(texts)] == library.encode(texts)
    streamed = [[i for s in own.segments.findall(own.normalized(t)) for done in own.stream(s) for p in done for i in own.ids_of(p)] for t in texts]
    assert streamed == library.encode(texts)


def test_unigram_path_is_the_best_one(library):
    own = pieces.Pieces(piece_model(), "unigram")
    rng = random.Random(1)
    for _ in range(20):
        text = "".join(rng.choice("the ancor ist") for _ in range(120))
        normal = own.normalized(text)
        best = [0.0]
        for i in range(1, len(normal) + 1):
            best.append(max(best[i - n] + own.score.get(normal[i - n : i], own.worst if n == 1 else -1e18) for n in range(1, min(16, i) + 1)))
        path = [p for done in own.stream((normal,)) for p in done]
        assert "".join(path) == normal and abs(sum(own.score.get(p, own.worst) for p in path) - best[-1]) < 1e-6


def test_window_stays_short():
    own = pieces.Pieces(piece_model())
    sizes = [sum(map(len, done)) for done in own.stream(["ab1-" * 5000])]
    assert sum(sizes) == 20_000 and max(sizes) <= 6 * own.longest


def test_commits_of_usual_and_long_texts(documents, library):
    own = pieces.Pieces(piece_model())
    usual = [r.text for r in documents.limit(40).collect()]
    words = sum(len(own.segments.findall(own.normalized(t))) for t in usual)
    assert [x.tolist() for x in own.encode(usual)] == library.encode(usual)
    assert own.commits > 500 and own.widest <= 4 * own.longest + pieces.CHUNK  # what is remembered isn't committed again
    runs = ["ab1-" * 40_000, "x" * 100_000, "ab1-" * 39_999 + " y"]
    before, own.widest = own.commits, 0
    assert [x.tolist() for x in own.encode(runs)] == library.encode(runs)
    assert own.commits - before > 10_000 and own.widest <= 4 * own.longest + pieces.CHUNK and words > 1000
    part = " ".join(usual)
    long = (part + "\n") * (1 + 50_000_000 // len(part))
    found = own.encode([long])[0]
    assert len(long) >= 50_000_000 and own.widest <= 4 * own.longest + pieces.CHUNK
    once = library.encode(part + "\n" + part)
    assert found[: len(once) - 40].tolist() == once[: len(once) - 40] and own.decode(found[:5000].tolist()) == long[: len(own.decode(found[:5000].tolist()))]


def test_one_object_for_both_uses(documents, library):
    own = pieces.Pieces(piece_model())
    texts = some_texts(documents)[:60]
    for _ in range(2):
        assert [int(c[-1]) if len(c) else 0 for c in token_counts.prefix_counts(own, texts)] == [len(x) for x in library.encode(texts)]
        assert [x.tolist() for x in own.encode(texts)] == library.encode(texts)


def test_prefix_counts(documents, library):
    texts = some_texts(documents)
    own = pieces.Pieces(piece_model())
    rng = random.Random(2)
    for text, counts in zip(texts, token_counts.prefix_counts(own, texts), strict=True):
        assert len(counts) == len(text)
        stored = token_counts.packed(counts)
        for n in rng.sample(range(1, len(text) + 1), min(8, len(text))):
            assert counts[n - 1] == len(library.encode(text[:n])) == token_counts.tokens_of(stored, n)
        keep = token_counts.longest_prefix(stored, 20)
        assert keep == max((n for n in range(len(text) + 1) if n == 0 or counts[n - 1] <= 20), default=0)


def test_count_tokens_and_encode(odd, library):
    want = sorted(((r.doc_id or -1), len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in odd.collect())
    got = token_counts.budgeted(token_counts.count_tokens(odd, piece_model()), 100).collect()
    assert sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens) for r in got) == want
    texts = {((r.doc_id or -1), len((r.text or "").encode())): r.text or "" for r in odd.collect()}
    for r in got:
        text = texts[(r.doc_id or -1), r.n_bytes]
        assert r.over_limit == (r.n_tokens > 100) and len(library.encode(text[: r.limit_chars])) <= 100 and (r.limit_chars == len(text) or len(library.encode(text[: r.limit_chars + 1])) > 100)
    ids = pieces.encode_documents(odd, piece_model()).collect()
    assert sorted(((r.doc_id or -1), r.n_tokens) for r in ids) == sorted((a, c) for a, _, c in want)
    assert all(r.round_trip is None for r in ids if r.ids is None) and sum(r.round_trip is False for r in ids) == 1
    assert token_counts.count_tokens(odd.limit(0), piece_model()).count() == 0 == pieces.encode_documents(odd.limit(0), piece_model()).count()


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            keep = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[k]
            if keep:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans(spark, odd, documents):
    rng = random.Random(5)
    made = [(1000 + i, "".join(rng.choice("0123456789. -@a%+()é") for _ in range(rng.randint(1, 60)))) for i in range(1500)]
    made += [(1, "1.2.3.4.5.6.7.8 1.2.3.999 00001.2.3.4 a@b.c%d@e.f.g x@y @z.c +1 (988) 555-2485"), (2, "4041894974608795 4041-8949-7460-8795 4041 8949 7460 8795 1"), (3, "9" * 3000), (4, "1 " * 3000), (5, "1." * 3000)]
    docs = documents.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame(made, "doc_id bigint, text string"))
    got = pii.find_personal_data(docs).select("doc_id", pii.listed(pii.KINDS[:4]).alias("s")).collect()
    assert sorted((str(r.doc_id), r.s) for r in got) == sorted((str(r.doc_id), base_spans(r.text or "")) for r in docs.collect())
    assert pii.find_personal_data(odd.limit(0)).count() == 0


def test_cues_find_unseen_values(spark):
    rows = [(i, f"write to mail: u{i}@x.org or call them") for i in range(12)] + [(50, "their mail: someone-at-home and more"), (51, "note: nothing"), *((60 + i, f"see: w{i}x{i}yz") for i in range(9))]
    got = {r.doc_id: [x.v for x in r.id] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[50] == ["someone-at-home"] and not any(v for k, v in got.items() if k != 50)


def test_long_values_are_taken_whole(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    head = "a1" * 64
    keys = {i: head + digits(200) for i in range(8)} | {20: digits(5000), 21: digits(300) + "f4041894974608795f" + digits(300), 22: "eyJ-_." * 700, 23: "ab12" * 500_000}
    docs = spark.createDataFrame([(i, f'set key="{k}" here') for i, k in keys.items()], "doc_id bigint, text string")
    found = pii.find_personal_data(docs).join(docs, "doc_id")
    got = {r.doc_id: r for r in found.select("doc_id", "id", pii.redacted(F.col("text"), pii.marked(pii.KINDS)).alias("t")).collect()}
    assert {i: [(x.s, x.e, x.v) for x in r.id] for i, r in got.items()} == {i: [(9, 9 + len(k), k)] for i, k in keys.items()}
    assert {r.t for r in got.values()} == {'set key="<id>" here'}
    # values that share their first characters are distinct for their cue
    same = spark.createDataFrame([(i, f'set key="{keys[i]}" here') for i in range(8)], "doc_id bigint, text string")
    assert all(len(r.id) == 1 for r in pii.find_personal_data(same).collect())


def test_labels_behind_labels(spark):
    from pyspark.sql import functions as F

    key = [f"24be{i}caf{i}e1d{i}f00d{i}" for i in range(9)]
    texts = [f"set password={k} and token = \"{k[::-1]}\" now" for k in key[:7]] + ["login: password=hunter2abc", f'note: token = "{key[7]}"', f"é #x a: b: /x/token = \"{key[8]}\" b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = pii.find_personal_data(docs).join(docs, "doc_id")
    got = {r.doc_id: r for r in found.select("doc_id", "text", "id", pii.redacted(F.col("text"), pii.marked(pii.KINDS)).alias("t")).collect()}
    assert [got[i].t for i in (0, 7, 8, 9)] == ["set password=<id> and token = \"<id>\" now", "login: password=<id>", 'note: token = "<id>"', "é #x a: b: /x/token = \"<id>\" b"]
    assert all(r.text[x.s : x.e] == x.v for r in got.values() for x in r.id)


def test_contexts_find_unseen_values(spark):
    """Prose without delimiters: two words before, and a word behind."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bdfgklmn") for _ in range(6))
    rows = [f"{word()} write to me at u{i}@x{i}.org when {word()} done, {word()}" for i in range(40)]
    rows += [f"{word()} {word()} in {1900 + i} {word()}" for i in range(40)] + ["they write to me at X-77123/4 when late", "call passport1: 12A4 in 2077 then"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    found = {r.doc_id: [x.v for x in r.id] for r in pii.find_personal_data(docs).collect() if r.id}
    assert found == {80: ["X-77123/4"]}


def test_scores_against_brute_force(spark):
    rng = random.Random(13)
    edges = list({(f"p{rng.randint(0, 12)}", f"v{rng.randint(0, 60)}") for _ in range(260)})
    seed = {v: rng.random() < 0.6 for v in {v for _, v in edges}}
    confidence = {v: float(seed[v]) for v in seed}
    for _ in range(3):
        values = {p: [v for q, v in edges if q == p] for p in {p for p, _ in edges}}
        score = {p: sum(confidence[v] for v in vs) / len(vs) for p, vs in values.items()}
        for v in seed:
            rest = 1.0
            for p, w in edges:
                if w == v and score[p] >= 0.5:
                    rest *= max(1e-9, 1 - score[p])
            confidence[v] = max(float(seed[v]), 1 - rest)
    got = {r.pattern: (r.score, r.n_values) for r in pii.score_patterns(spark.createDataFrame([(p, v, seed[v]) for p, v in edges], "pattern string, value string, seed boolean")).collect()}
    assert got.keys() == score.keys() and all(abs(got[p][0] - score[p]) < 1e-9 and got[p][1] == len(values[p]) for p in got)


def test_covered_characters_against_brute_force(spark):
    rng = random.Random(14)
    spans = lambda n: [(s := rng.randint(0, 150), s + rng.randint(1, 30)) for _ in range(n)]
    made = {r: (spans(rng.randint(0, 12)), sorted(set(spans(rng.randint(1, 9))))) for r in range(40)}
    box = "struct<s:int,e:int,v:string,p:array<string>>"
    bases = spark.createDataFrame([(r, (s, e, "", [])) for r, (b, _) in made.items() for s, e in b], f"__row bigint, b {box}")
    tried = spark.createDataFrame([(r, True, (s, e, "", [])) for r, (_, c) in made.items() for s, e in c], f"__row bigint, is_cue boolean, x {box}")
    got = {(r["__row"], r.x.s, r.x.e): r.covered for r in pii._covered(tried, bases).collect()}
    assert got == {(r, s, e): sum(any(x <= i < y for x, y in b) for i in range(s, e)) for r, (b, c) in made.items() for s, e in c}


def test_many_matches_in_one_text(spark):
    """100,000 addresses in one text: the work grows with the matches, not with their square."""
    import time

    text = " ".join(f"u{i}@x.org key: a{i}b" for i in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.time()
    row = pii.find_personal_data(docs).select("email").first()
    assert len(row.email) == 100_000 and all(text[x.s : x.e] == x.v for x in row.email[::997]) and time.time() - began < 60


def test_redaction(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "é me@x.org, +1 (988) 555-2485, card 4041894974608795 at 10.0.0.1 end")], "doc_id bigint, text string")
    found = pii.find_personal_data(docs).join(docs, "doc_id")
    text = found.select(pii.redacted(F.col("text"), pii.marked(pii.KINDS)).alias("t")).first()["t"]
    assert text == "é <email>, <phone>, card <card> at <ip> end"


def test_redaction_against_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(15)
    made = [("", []), ("😀" * 2048, []), ("é😀\n" * 1024, [(0, 3072)]), ("ab" * 1024, [(2047, 2048)])]
    for _ in range(60):
        text = "".join(rng.choice("aé日😀\n ") for _ in range(rng.choice((5, 1023, 1024, 1025, 5000))))
        made.append((text, sorted((s := rng.randrange(len(text)), min(len(text), s + rng.randint(1, rng.choice((4, 3000))))) for _ in range(rng.randint(0, 8)))))
    want = []
    for text, spans in made:
        out, at = "", 0
        for s, e in spans:
            if s >= at:
                out += text[at:s] + "<k>"
            at = max(at, e)
        want.append(out + text[at:])
    rows = spark.createDataFrame([(i, t, [(s, 0, e, "k") for s, e in x]) for i, (t, x) in enumerate(made)], "i int, t string, x array<struct<s:int,i:int,e:int,k:string>>")
    got = {r.i: r.r for r in rows.select("i", pii.redacted(F.col("t"), F.col("x")).alias("r")).collect()}
    assert got == dict(enumerate(want))


def test_png_filters_and_checksums():
    rng = np.random.default_rng(1)
    width, image = 40, rng.integers(0, 256, (10, 40))
    data, above = b"", [0] * width
    for k, row in enumerate(image.tolist()):
        kind, out = k % 5, []
        for i, v in enumerate(row):
            a, b, c = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            p = a + b - c
            out.append((v - (0, a, b, (a + b) // 2, min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2])[kind]) % 256)
        data, above = data + bytes([kind, *out]), row
    png = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", width, 10, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(data)) + media._chunk(b"IEND", b"")
    assert (media.decode_png(png) == image).all()
    broken = bytearray(png)
    broken[40] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(broken))


def test_images(odd):
    images, features = media.image_columns(odd)
    stored_media = {r.media for r in images.collect()}
    got = features.collect()
    assert len(got) == images.count() == odd.count()
    texts = sorted((r.doc_id or -1, r.text or "") for r in odd.collect())
    seen = {}
    for r, (i, text) in zip(sorted(got, key=lambda r: (r.doc_id or -1, r.n_bytes)), sorted(texts, key=lambda x: (x[0], len(x[1].encode()))), strict=True):
        stored = media.padded(text.encode())
        assert (r.doc_id or -1) == i and r.n_bytes == len(text.encode()) and r.payload_bytes == len(stored) and r.payload_bytes % 576 == 0
        assert r.payload_sha256 == hashlib.sha256(stored).hexdigest() and r.tail_crc32 == zlib.crc32(stored[-32:])
        image = next(m for m in stored_media if hashlib.sha256(m).hexdigest() == r.media_sha256)
        assert media.decode_png(image).tobytes() == stored and r.media_bytes == len(image)
        assert seen.setdefault(text, (r.feature, r.media_sha256)) == (r.feature, r.media_sha256)
    assert media.image_columns(odd.limit(0))[1].count() == 0


def test_archive(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    from pyspark.sql import functions as F

    more = pages.where("page_id < 9").withColumn("page_id", F.col("page_id") + 1000)
    odd = spark.createDataFrame([(5000, "u\r\nx", None), (None, None, ""), (5001, "é ü", ""), (5001, "é ü", "")], pages.schema)
    rows = pages.union(more).union(odd).withColumn("size", F.lit(1)).withColumn("first", F.lit("x"))
    source = rows.collect()
    largest = {}
    for r in source:
        data = (r.html or "").encode()
        largest[data] = max(largest.get(data, -1), -1 if r.page_id is None else r.page_id)
    payloads = {r.page_id: (r.html or "").encode() for r in source}
    got = warc.archive(rows, bundle_bytes=40_000, frame_bytes=9_000).collect()
    assert len(got) == len(source)
    for r in got:
        data = payloads[r.page_id]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if r.page_id == largest[data]:
            assert (r.record_type, r.refers_to, r.payload) == ("response", None, data)
        else:
            assert (r.record_type, r.refers_to) == ("revisit", largest[data])
    assert warc.archive(pages.limit(0)).count() == 0


def test_bundles_are_plain_zstandard(tmp_path):
    import io

    import zstandard

    path = tmp_path / "b.zst"
    writer = warc.BundleWriter(path.open("wb"), frame_bytes=500)
    records = [warc.record(i, f"http://x/{i}", b"p" * (i * 50), i * 50, hashlib.sha1(b"p" * (i * 50)).digest()) for i in range(12)]
    places = [writer.add(r) for r in records]
    writer.close()
    data = path.read_bytes()
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as r:
        assert r.read() == b"".join(records)
    reader = warc.BundleReader(io.BytesIO(data))
    for (frame, offset), own in reversed(list(zip(places, records, strict=True))):
        assert reader.read(frame, offset, len(own)) == own
    assert len(reader.sizes) > 3


def test_capitals_count_in_any_script_and_length():
    at = toxicity.FEATURES.index("capital_rate")
    for word in ("ПРИВЕТ", "ΚΑΛΗΜΕΡΑ", "ŁÓDŹ", "İŞÇİ", "ŒUVRE", "HÄUSER"):
        assert [toxicity._features(f"{word} " * n, {}, {})[at] for n in (3, 300)] == [1.0, 1.0]


def test_features_against_brute_force(spark, odd, documents):
    """Each feature by its definition, over lists of words and pairs of places."""
    lexicon = {"the": 1.5, "ides-": 2.5, "zor": 2.0, "idio-": 3.0}
    texts = [r.text for r in odd.collect()] + [r.text for r in documents.limit(50).collect()] + ["You IDIOT!! y0u are an 1d10t, ZOR zor.", "sooooo st-u-p-i-d you", "THE 123 !!! $$$"]
    texts = [t for t in texts if len(t or "") < 20_000]
    rows = toxicity.features(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), lexicon).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        tokens = text.split()
        words = [toxicity.plain(t) for t in tokens]
        weight = [lexicon.get(w, 0.0) for w, _ in words]
        stem = [max([lexicon.get(w[:n] + "-", 0.0) for n in (4, 5) if len(w) > n], default=0.0) for w, _ in words]
        hit = [i for i, (w, _) in enumerate(words) if w in toxicity.INSULTS or weight[i] or stem[i]]
        you = [i for i, (w, _) in enumerate(words) if w in toxicity.SECOND_PERSON]
        n = max(1, len(tokens))
        insults = sum(words[i][0] in toxicity.INSULTS for i in hit)
        want = {
            "log_words": np.log(1 + len(tokens)), "insult_rate": insults / n, "insult_count": insults, "word_rate": sum(w > 0 for w in weight) / n, "word_max": max([*weight, 0.0]), "stem_rate": sum(s > 0 for s in stem) / n, "stem_max": max([*stem, 0.0]),
            "hits_near_you": sum(any(abs(i - j) <= 5 for j in you) for i in hit) / max(1, len(hit)), "you_rate": len(you) / n, "capital_rate": sum(c.isupper() for c in text) / max(1, sum(c != " " for c in text)),
            "shout_rate": sum(t.isupper() and len(w) > 2 for t, (w, _) in zip(tokens, words, strict=True)) / n, "bang_rate": sum(c == "!" for c in text) / n, "punct_rate": len([c for c in text if not re.match(r"[\w\s]", c)]) / n,
            "obfuscated_rate": sum(h for _, h in words) / n, "disguised_hits": sum(words[i][1] for i in hit),
        }
        assert set(want) == set(toxicity.FEATURES) and all(abs(r[k] - v) < 1e-9 for k, v in want.items()), r.doc_id


def test_toxicity_learns_and_ignores_held_out_labels(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 8 == 0
        words = [word() for _ in range(40)]
        if toxic:
            words[5], words[20] = "zorkable", "quibberish"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").union(spark.createDataFrame([(None, None), (5000, "")], "doc_id bigint, text string"))
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = toxicity.score_toxicity(docs, known, rounds=5).collect()
    assert len(got) == 1202 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 1200]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in held) / len(held) > 0.97
    turned = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels], "doc_id bigint, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, turned, rounds=5).collect()}
    assert again == {r.doc_id: r.score for r in got}
    empty = toxicity.score_toxicity(docs.limit(0), known.limit(0)).collect()
    assert empty == []
