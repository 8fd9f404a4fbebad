"""Quality, HTML text, SimHash, MPEG audio and PII: brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import html_text, media, pii, quality, queries, simhash

from ..oracle import assert_same
from .test_native import docs

# quality


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.queries()["op2_quality"](spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert auc(np.array([r["score"] for r in held]), np.array([r["quality"] for r in held])) > 0.9
    assert sum(r["predicted"] == r["quality"] for r in held) > 0.85 * len(held)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_quality_never_reads_held_out_labels(spark, sf):
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = lab.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(d, x) for x in (lab, flipped))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_quality_edges(spark):
    rows = [(i, "good text here" if i % 2 else "zz zz zz zz") for i in range(30)] + [(30, None), (31, ""), (None, "good"), (2, "zz zz zz zz")]
    df = docs(spark, rows)
    lab = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 0), (None, 1), (4, None)], "doc_id bigint, quality int")
    model = quality.fit(df, lab)
    got = {(r["rec"]["doc_id"], r["rec"]["text"]): r["score"] for r in quality.scored(df, model).collect()}
    assert got[5, "good text here"] > 0.5 > got[6, "zz zz zz zz"] and got[30, None] == got[31, ""]
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {1, 3, 5}
    assert {r["score"] for r in quality.scored(df, quality.fit(df, lab.limit(0))).collect()} == {0.5}
    assert quality.scored(df.limit(0), model).count() == 0
    ids, counts = quality.text_features("word " * 200_000)
    assert counts.sum() > 200_000 and len(ids) < 50


def brute_features(text):
    """Buckets of words, of their character 2- and 3-grams and of word pairs, one by one."""
    ws, out, top = (text or "").split(), [], 1 << 64
    bucket = lambda h: (h * 2654435761 % top >> 24) % quality.BUCKETS
    mixed = lambda x, y: (x * 2654435761 + y * 2246822519) % top
    crc = lambda w: zlib.crc32(f"w{w}".encode())
    for w in ws:
        own = [ord(c) for c in f"<{w}>"]
        out.append(crc(w) % quality.BUCKETS)
        for k in range(len(own) - 1):
            h = mixed(own[k], own[k + 1])
            out.append(bucket(h))
            if k + 2 < len(own):
                out.append(bucket(mixed(h ^ h >> 29, own[k + 2])))
    return out + [bucket(mixed(crc(a), crc(b))) for a, b in zip(ws, ws[1:])]


def test_quality_scores_are_the_softmax_of_averages(spark):
    rng = random.Random(2)
    words = ["good", "text", "zz", "é", "日本", "a", "longer-word", "x" * 40]
    texts = [None, "", " ", "one"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    rows = [(np.array(sorted(set(f)), np.int32), np.array([f.count(x) for x in sorted(set(f))], np.int32), k % 2) for k, f in enumerate(map(brute_features, texts[3:]))]
    for (ids, counts, _), t in zip(rows, texts[3:]):
        own = quality.text_features(t)
        assert np.array_equal(ids, own[0]) and np.array_equal(counts, own[1])
    numbers, bias = model = quality.train(rows)
    got = {r["rec"]["doc_id"]: r["score"] for r in quality.scored(docs(spark, list(enumerate(texts))), model).collect()}
    for k, t in enumerate(texts):
        f = brute_features(t)
        z = bias + (sum(numbers[x] for x in f) / len(f) if f else 0.0)
        assert abs(got[k] - 1 / (1 + np.exp(-z))) < 1e-9


def test_quality_shuffled_labels_are_chance(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = sorted((r["doc_id"], r["quality"]) for r in lab.collect())
    mixed = [q for _, q in rows]
    random.Random(1).shuffle(mixed)
    model = quality.fit(d, spark.createDataFrame([(i, q) for (i, _), q in zip(rows, mixed)], "doc_id bigint, quality int"))
    held = {i: q for (i, _), q in zip(rows, mixed) if zlib.crc32(str(i).encode()) % 3 == 1}
    got = [(r["score"], held[r["rec"]["doc_id"]]) for r in quality.scored(d, model).collect() if r["rec"]["doc_id"] in held]
    assert 0.25 < auc(np.array([s for s, _ in got]), np.array([q for _, q in got])) < 0.75


# HTML


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


ARTICLE = "<p>First paragraph, with some words in it.</p>\n<p>Second  one:\n it &amp; has&nbsp;<b>bold</b> text, too.</p>"
TEXT = "First paragraph, with some words in it.\nSecond one: it & has bold text, too."


@pytest.mark.parametrize("source,want", [
    (None, ""), ("", ""), ("   ", ""), ("just text", "just text"), (page(""), ""),
    (page(f"<nav><a href=x>Home</a><a>About</a></nav><article>{ARTICLE}</article><footer>All rights, reserved.</footer>"), TEXT),
    (page(f"<div class='menu'><ul><li>One<li>Two</ul></div><div class=content>{ARTICLE}</div><div id=sidebar>Links, links.</div>"), TEXT),
    (page(f"<main>{ARTICLE}<div class='comments'><p>Great, really great, post!</p></div><form><p>Name, please.</p></form></main>", "<style>p{}</style><script>if (a<b) x('</p>')</script>"), TEXT),
    (page(f"<article>{ARTICLE}<script>var a = '<p>no</p>';</script><!-- <p>no</p> --></article><div class='cookie-notice'>We use cookies.</div>"), TEXT),
    ("<p>unclosed <b>tags here, a lot of words", "unclosed tags here, a lot of words"),
    (page("<article><h1>Title</h1><p>a<br>b</p><ul><li>x</li><li>y</li></ul></article>"), "Title\na b\nx\ny"),
])
def test_html(source, want):
    assert html_text.main_text(source) == want


def test_html_long_and_table(spark):
    n = 20_000
    body = "<article>" + "".join(f"<p>Paragraph {i}, of many.</p>" for i in range(n)) + "</article>"
    assert html_text.main_text(page(body)).count("\n") == n - 1
    assert html_text.main_text("<div>" * 3000 + "deep, text here" + "</div>" * 3000) == "deep, text here"
    assert html_text.main_text("<" * 100_000) is not None
    df = spark.createDataFrame([(1, "u", page(f"<article>{ARTICLE}</article>"), 5), (1, "u", page(f"<article>{ARTICLE}</article>"), 5), (None, None, None, None)], "page_id bigint, url string, html string, n_chars int")
    got = html_text.extract(df).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == [("1", len(TEXT)), ("1", len(TEXT)), ("None", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_query(spark, sf):
    out = queries.queries()["op5_html_text"](spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) and not re.search(r"</?(p|div|script|nav)\b", r["text"]) for r in out)


# SimHash


def brute_print(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a B", "a b c", "A b C d", "é É ß x\x0by", "w " * 70_000 + "end", "nbsp joined word two three"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_simhash_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_print(r["text"]) for r in rows]
    want = {r["doc_id"]: (f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components([r["doc_id"] for r in rows], fps))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.queries()["op6_simhash"](spark, sf).collect()}
    assert got == want


def clustered(rng, n):
    """Fingerprints in chains and bunches of few differing bits."""
    out = []
    while len(out) < n:
        f = rng.getrandbits(64) & rng.choice([(1 << 64) - 1, 0xFFFF, 0xFFFFFFFF00000000])
        for _ in range(rng.randrange(1, 8)):
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                f ^= 1 << b
            out.append(f)
    return list(dict.fromkeys(out))[:n]


@pytest.mark.parametrize("bucket", [4096, 4])
def test_components_from_fingerprints(spark, bucket):
    fps = clustered(random.Random(bucket), 300)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df, bucket).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    known = {r["v"] % (1 << 64): r["root"] for r in simhash.components(simhash.links(df, bucket)).collect()}
    want = brute_components(list(range(len(fps))), fps)
    groups = {}
    for f, c in zip(fps, want):
        groups.setdefault(c, []).append(f)
    for own in groups.values():
        assert len({known.get(f, f) for f in own}) == 1
    assert len({known.get(f, f) for f in fps}) == len(groups)


@pytest.mark.parametrize("n", [1, 31, 33, 700])
def test_gray_index(n):
    fps = np.array(clustered(random.Random(n), n), np.uint64)
    index = simhash.GrayIndex(fps)
    assert sorted(index.fps.tolist()) == sorted(fps.tolist())
    for q in fps[:20]:
        fresh = simhash.GrayIndex(fps)
        got = sorted(fresh.fps[fresh.take(q)].tolist())
        assert got == sorted(int(f) for f in fps if (int(f) ^ int(q)).bit_count() <= 3)
        assert len(fresh.take(q)) == 0  # taken already


def test_gray_rank():
    codes = np.arange(16, dtype=np.uint64)
    gray = codes ^ (codes >> np.uint64(1))
    assert (simhash.gray_rank(gray) == codes).all()


def test_long_chain(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a bigint, b bigint")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.limit(0)).count() == 0


def test_simhash_edges(spark):
    t = "some words that make a text of a fair length " * 5
    rows = [(5, t), (3, t), (3, t), (9, t.upper()), (7, None), (8, ""), (None, "alone in here"), (None, "another one that is alone"), (2, "x " * 50_000), (11, "twice the id"), (11, "same id and different text")]
    df = docs(spark, rows)
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (3, 3), (9, 3), (7, 7), (8, 7), (None, None), (None, None), (2, 2), (11, 11), (11, 11)], key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, t), (7, None), (None, "alone in here"), (None, "another one that is alone"), (2, "x " * 50_000), (11, "twice the id"), (11, "same id and different text")], key=str)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.keep_one(docs(spark, [])).count() == 0


# media


@pytest.mark.parametrize("text", [None, "", "a", "é" * 40, "x" * 64, "x" * 65, "\0", "ID3" + "\xff\xfb" * 900, "𝒳" * 5000, "y" * 300_000])
def test_media_round_trip(text):
    payload, n = media.payload_of(text)
    raw = (text or "").encode()
    assert n == len(raw) and payload[:n] == raw and len(payload) % 64 == 0 and len(payload) >= 64 and not payload[n:].strip(b"\0")
    stream = media.encode(payload, n)
    audio = media.parse(stream)
    assert media.decode(stream) == payload and stream == media.encode(payload, n)
    assert audio.damaged == audio.skipped == 0 and audio.vbr["frames"] == len(audio.offsets)
    assert audio.duration == media.Fraction(1152 * len(audio.offsets), 32000)
    assert all(stream[o] == 0xFF for o in audio.offsets)


def test_media_damage():
    payload = bytes(range(256)) * 40
    stream = media.encode(payload)
    whole = media.parse(stream)
    junk = media.parse(stream[: whole.offsets[2]] + b"\xff\x00junk\xff\xfa" + stream[whole.offsets[2] :])
    assert len(junk.offsets) == len(whole.offsets) and junk.skipped == 8
    bad = bytearray(stream)
    bad[whole.offsets[1] + 7] ^= 1  # in the side information, which the checksum covers
    assert media.parse(bytes(bad)).damaged == 1
    with pytest.raises(ValueError):
        media.decode(bytes(bad))
    lost = bytearray(stream)
    lost[whole.offsets[1] + 60] ^= 1  # in the payload
    with pytest.raises(ValueError):
        media.decode(bytes(lost))
    tagged = media.parse(stream + b"TAG" + b"A title".ljust(125, b"\0"))
    assert tagged.tags["TIT2"] == "A title" and len(tagged.offsets) == len(whole.offsets)
    for noise in (b"", b"\xff", b"\xff\xfb", b"ID3", bytes(1000), b"\xff" * 1000, random.Random(1).randbytes(5000)):
        media.parse(noise)
    assert media.parse(None).duration == 0


def test_crc16():
    def by_bits(data):
        crc = 0xFFFF
        for bit in "".join(f"{b:08b}" for b in data):
            top = (crc >> 15) ^ int(bit)
            crc = (crc << 1) & 0xFFFF
            if top:
                crc ^= 0x8005
        return crc

    for data in (b"", b"\0", b"123456789", bytes(range(50))):
        assert media.crc16(data) == by_bits(data)


def test_media_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.queries()["op7_mpeg_audio"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        frames = -(-max(1, -(-len(raw) // 64)) * 64 // (1440 - 38))  # of 320 kbit/s at 32 kHz: 1440 bytes, 38 of them header and silence
        d = media.Fraction(1152 * frames, 32000)
        assert f" frames={frames} duration={d.numerator}/{d.denominator} " in r["feature"]
        stream = media.encode(*media.payload_of(texts[r["doc_id"]]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest()) and r["feature"].endswith("damaged=0 skipped=0")
        padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_media_columns(spark):
    df = spark.createDataFrame([("a", media.encode(b"x" * 5000)), ("b", b"no audio"), ("c", None)], "id string, content binary")
    got = {r["id"]: r for r in media.audio_columns(df).collect()}
    assert got["a"]["n_frames"] == len(got["a"]["offsets"]) > 0 and got["b"]["n_frames"] == got["c"]["n_frames"] == 0
    assert media.audio_columns(df.limit(0)).count() == 0


# PII


def brute_base(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii_random():
    rng = random.Random(5)
    pieces = ["a", "B.c", "@", "@x.y", "x@y.z", "a@b", "..", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "0001.2.3.4", "+", "+1 (555) 123-4567", "+49 30 1234567", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "1 2", "-", " ", "\n", "é", "１２", "9" * 25, "%_", "a@b-c.d@e.f", "account: 12345678", "+1"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 9)))
        assert [s for s in pii.spans(text) if s[1] < 4] == brute_base(text), text


def test_pii_added_kinds():
    def kinds(text):
        return [(pii.KINDS[k], text[a:b]) for a, k, b in pii.spans(text) if k > 3]

    assert kinds("pay DE89 3704 0044 0532 0130 00 now") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("pay DE88 3704 0044 0532 0130 00 now") == []
    assert kinds("Account no. 12345678, acct: 99") == [("account", "12345678")]
    assert kinds("see https://bob:pw@host/x or http://host/@y") == [("login", "bob:pw")]
    assert kinds("accountant 12345678") == []
    assert kinds("IBAN: de89 3704 0044 0532 0130 00.") == [("iban", "de89 3704 0044 0532 0130 00")]
    assert kinds("iban DE89370400440532013000") == [("iban", "DE89370400440532013000")]
    assert kinds("Passport no. C01X00T47, passport: ABCDEFG") == [("passport", "C01X00T47")]
    assert kinds("<a href='mailto:a.b@x.org,\u00e9@y.org?subject=1@2'>") == [("mailto", "a.b@x.org,\u00e9@y.org")]


def brute_added(text):
    """The added kinds by patterns over the whole text."""
    out, at = [], 0
    while m := re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}").search(text, at):
        at = m.start() + 1
        for end in range(m.end(), m.start() + 14, -1):
            s = text[m.start() : end].replace(" ", "")
            if text[end - 1] != " " and 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
                out.append((m.start(), 4, end))
                at = end
                break
    for m in re.finditer(r"(?:account|Account|ACCOUNT|acct|konto|ssn|routing)(?i:\s*(?:no|nr|number|num)?)[.:#=\s]{1,4}([0-9][0-9 -]{4,20}[0-9])", text):
        if 6 <= len(re.sub("[^0-9]", "", m[1])) <= 17:
            out.append((m.start(1), 5, m.end(1)))
    out += [(m.start(1), 6, m.end(1)) for m in re.finditer(r"(?:https?|ftp|ssh)://([^\s/@?#]+)@", text)]
    out += [(m.start(1), 8, m.end(1)) for m in re.finditer(r"(?:passport|Passport)(?i:\s*(?:no|nr|number|num)?)[.:#=\s]{1,4}([A-Z0-9]{6,9})(?![A-Za-z0-9])", text) if len(re.sub("[^0-9]", "", m[1])) >= 4]
    return sorted(out)


def test_pii_added_random():
    rng = random.Random(8)
    pieces = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "XX12", "account: 12345678", "acct 99", "konto=1234-5678 90", "ssn 123-45-6789", "http://bob:pw@h", "ssh://me@", "passport C01X00T47", "Passport no. 123456789", "A", "9", " ", ",", "é", "/", "x"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", "; "]) for _ in range(rng.randrange(0, 8)))
        assert [s for s in pii.spans(text) if s[1] in (4, 5, 6, 8)] == brute_added(text), text


def test_pii_and_media_text_ids(spark):
    df = spark.createDataFrame([("a", "b@c.de"), (None, None)], "doc_id string, text string")
    assert sorted((str(r["doc_id"]), r["spans"]) for r in pii.scan(df).collect()) == [("None", ""), ("a", "email:0:6")]
    assert sorted((str(r["doc_id"]), r["n_bytes"]) for r in media.store(df).collect()) == [("None", 0), ("a", 6)]


def test_pii_edges(spark):
    assert pii.spans(None) == pii.spans("") == []
    for n in (1000, 300_000):
        long = "a" * n + "@" + "b" * 1000 + ".com " + "@" * 1000 + "1" * n + "." * 1000 + "+" * n
        found = [s for s in pii.spans(long) if s[1] < 4]
        assert found == (brute_base(long) if n == 1000 else [(0, 0, n + 1005)])  # the plain patterns take the square of n
    assert pii.redact("mail bob@x.org, call +1 555 123 4567.") == "mail [EMAIL], call [PHONE]." and pii.redact(None) is None
    df = docs(spark, [(1, None), (1, None), (2, "b@c.de"), (None, "")])
    assert sorted(((str(r["doc_id"]), r["n_email"], r["spans"]) for r in pii.scan(df).collect())) == [("1", 0, ""), ("1", 0, ""), ("2", 1, "email:0:6"), ("None", 0, "")]
    assert pii.scan(docs(spark, [])).count() == 0


def test_pii_query(spark, sf):
    assert_same(queries.queries()["op8_pii"](spark, sf).drop("spans"), pii.BASE_SQL, sf)
