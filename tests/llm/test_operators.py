"""Each operator against a plain, slow version, on rows with nulls, empty and long texts, ties, copies and clashing columns."""

import base64
import hashlib
import itertools
import random
import re
from collections import Counter
from math import log10

import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import common, decontam, langid, lm, mixing, pii, quality, rules, secrets, similar, simhash, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string, blob string, kept int, position string"
R = random.Random(4)
WORDS = ["the", "and", "of", "über", "señal", "ab", "Cd", "x9", "là", "idiot", "Trash!", "a.b", "q" * 30]


def text(n):
    return "".join(R.choice(WORDS) + R.choice([" ", " ", "\n", "\t", "  "]) for _ in range(n))


BENCH = [("b1", " ".join(f"w{i}" for i in range(20))), ("b2", "short item, here"), ("b3", None), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), ("b1", "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15")]
TEXTS = [
    None, "", " \n\t", "one", "W1 w2 W3 w4-w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 tail", "x short ITEM here short item here y", text(60), text(400), text(9000), "same same same same\nsame\nsame\n\n x\n x",
    'token = "abcdefgh12" secret: token:abcdef AKIA' + "A1" * 9 + " é password=ab api_key='zzzzzz' " + "0f" * 16, "mail a.b@c.de, x@y ü+1 (234) 555-6789 4465758382889437 4465758382889437 10.0.0.256 1.2.3.4.5 a@b.c_d@e.f",
    "-----BEGIN RSA PRIVATE KEY----- password\x20\x20=\x20\x20'" + "s" * 50, "😀 token=😀 token=abcdef😀 " * 3, "#*$%&|<> a b c a b c a b c", text(60), "call (555) 123-4567 or 555-123-4567 now",
]
ROWS = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "S"][i % 4], 0, 1, "z", "z", 9, "p") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[6], ROWS[6], (None, TEXTS[7], "en", "s1", 0, 1, "z", "z", 9, "p"), (40, TEXTS[7], "en", "s1", 0, 1, "z", "z", 9, "p"), (41, TEXTS[7].replace("ab", "abc", 1), "de", "s1", 0, 1, "z", "z", 9, "p")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return repr(r)


def same(df, want, cols):
    assert sorted(map(key, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(key, want))


def ws(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def base_secrets(t):
    out = []
    for order, (kind, pattern, ok) in enumerate([("assign", r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t or "") if ok(m)]
    return [s for _, _, s in sorted(out)]


def test_secrets(spark, docs, empty):
    got = secrets.digest(secrets.scan(docs, secrets.BlobLedger(spark)))
    want = [(r[0], *(sum(s.startswith(k) for s in base_secrets(r[1])) for k in secrets.BASE), sha(",".join(base_secrets(r[1])))) for r in ROWS]
    same(got, want, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"])
    assert all(set(base_secrets(next(x[1] for x in ROWS if x[0] == r["doc_id"]))) <= set(r["spans"].split(",")) for r in got.where("spans <> ''").collect())
    assert secrets.scan(empty, secrets.BlobLedger(spark)).count() == 0


def test_secret_ledger_scans_each_blob_once(spark, docs):
    ledger = secrets.BlobLedger(spark)
    first = secrets.scan(docs, ledger).count()
    rows = ledger.read().count()
    assert first == len(ROWS) and rows == len({r[1] or "" for r in ROWS})
    secrets.scan(docs, ledger)
    assert ledger.read().count() == rows
    secrets.scan(docs, ledger, "next").count()
    assert ledger.read().count() == 2 * rows


def test_many_secrets_in_a_text_and_redaction(spark):
    t = "token=abcdef é " * 1500
    df = spark.createDataFrame([(1, t, len(t))], "doc_id long, text string, n_chars long")
    assert secrets.digest(secrets.scan(df, secrets.BlobLedger(spark))).first()["base_sha256"] == sha(",".join(base_secrets(t)))
    out = secrets.redact_documents(df, secrets.BlobLedger(spark)).first()
    assert out["text"] == "[REDACTED] é " * 1500 and out["n_chars"] == len(out["text"])


def test_private_keys_go_with_their_bodies(spark):
    body = "\n".join("".join(R.choice("ABCxyz019+/") for _ in range(64)) for _ in range(20)) + "\nAbC9=="
    key = lambda kind, head="", end=True: f"-----BEGIN {kind}-----\n{head}{body}\n" + (f"-----END {kind}-----" if end else "")
    keys = [key("RSA PRIVATE KEY"), key("PGP PRIVATE KEY BLOCK", "Version: GnuPG v1 (a-b)\n\n"), key("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789abcdef0123456789abcdef\n\n"), key("PRIVATE KEY").replace("\n", "\\n")]
    keys += [key("PRIVATE KEY", end=False), key("PRIVATE KEY", "Version: 1\n\n", False), "-----BEGIN PRIVATE KEY-----", f"-----BEGIN PRIVATE KEY-----\n{(body[:64] + chr(10)) * 3000}-----END PRIVATE KEY-----"]
    texts = [f"before {k} after these words\n" if k.endswith("-----") else f"before {k}after these words\n" for k in keys]
    texts += [f"secret: {keys[0]} after these words\n", "-----BEGIN PRIVATE KEY----- prose of some length\n" + keys[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in secrets.redact_documents(df, secrets.BlobLedger(spark)).collect()}
    assert not any(x in t for t in out.values() for x in (body[:64], body[70:120], "AbC9", "-----BEGIN", "DEK-Info"))
    assert all(t.startswith("before [REDACTED]") and t.split()[-3:] == ["after", "these", "words"] for i, t in out.items() if i < 8) and out[9].startswith("[REDACTED] prose of some length\n[REDACTED]")
    spans = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(df, secrets.BlobLedger(spark))).collect()}
    assert all(f"pem:7:{7 + len(k)}" in spans[i].split(",") for i, k in enumerate(keys) if k.endswith("-----"))


def test_language(spark, docs, empty):
    made = [(i, " ".join(R.choice(["the", "and", "with", "this", "over"] if i % 2 else ["der", "und", "nicht", "über", "schön"]) for _ in range(R.randint(3, 40))), "en" if i % 2 else "de") for i in range(300)]
    got = langid.language_id(spark.createDataFrame(made, "doc_id long, text string, lang string")).collect()
    truth = {i: x for i, _, x in made}
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    odd = {r["doc_id"]: r for r in langid.language_id(docs).collect()}
    assert len(odd) == 20 and odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[2]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in odd.values())
    assert langid.language_id(empty).count() == 0


def test_rules(docs, empty):
    def want(t):
        w = ws(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if ws(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)

    got = rules.judge(docs)
    same(got, [(r[0], *want(r[1]), want(r[1])[0] < 50 or 100 * want(r[1])[4] > 50 * want(r[1])[0]) for r in ROWS], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    assert got.where("base_failed and kept").count() == 0 and rules.judge(empty).count() == 0


def test_rules_keep_a_reference_for_every_language(spark):
    own = lambda i: " ".join(("DER" if i % 2 else "x9") for _ in range(120))
    made = spark.createDataFrame([(i, own(i), f"l{i:04d}") for i in range(1100)], "doc_id long, text string, lang string")
    got = rules.judge(made).collect()
    assert len(got) == 1100 and all(r["class_distance"] < 1e-6 and r["common_distance"] < 1e-6 for r in got)


def test_jensen_shannon(spark):
    d = lambda a, b: spark.range(1).select(rules.distance(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))).first()[0]
    assert d([1, 2], [2, 4]) < 1e-6 and abs(d([1, 0], [0, 3]) - 1) < 1e-9 and d([0, 0], [1, 1]) is None


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((r[0] or -1, len(ws(r[1]))) for r in ROWS)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is None) == (r["taken"] == 0 or r["position"] is None)
    total = sum(r["size"] for r in got)
    assert abs(sum(rows[0]["target"] for rows in by.values()) - 1.5 * total) < 1e-6
    for rows in by.values():
        assert rows[0]["source_size"] == sum(r["size"] for r in rows) and abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 1 and rows[0]["target"] <= 2 * rows[0]["source_size"] + 1e-9
    again = mixing.mix(docs.repartition(5)).select("doc_id", "taken", "position").collect()
    assert sorted(map(repr, map(tuple, again))) == sorted(repr((r["doc_id"], r["taken"], r["position"])) for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.in_training_order(mixing.mix(docs)).where("taken = 0").count() == 0


def test_training_sequence(docs, empty):
    """Each pass over a document is an entry, and entries stand by place; the documents are read from them."""
    entries = mixing.in_passes(mixing.mix(docs), 3)
    places = [r["place"] for r in entries.collect()]
    taken = [x for x in places if x is not None]
    assert taken == sorted(taken) and None not in places[: len(taken)]
    mixed = mixing.mix(docs, ["doc_id"])
    want = sorted(map(repr, mixed.collect()))
    assert len(taken) == sum((r["position"] is not None) + (r["position2"] is not None) for r in mixed.collect()) > mixed.where("taken > 0").count()
    assert entries.agg(F.sum("words")).first()[0] == mixed.agg(F.sum("taken")).first()[0]
    assert sorted(map(repr, mixing.sequenced(docs).collect())) == want and mixing.sequenced(empty).count() == 0


def test_water_filling():
    got = mixing.targets([("b", 10), (None, 1000), ("a", 10), ("c", 980)])
    assert [g[0] for g in got] == ["a", "b", "c", None] and got[0][2] == 20 and abs(sum(g[2] for g in got) - 3000) < 1e-9


@pytest.mark.parametrize("least, hot", [(0, warc.HOT), (5, warc.HOT), (0, 1)])
def test_warc_round_trip(spark, monkeypatch, least, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    html = [None, "", "<p>é</p>", "<p>é</p>", "x" * (3 * warc.CHUNK + 5), "WARC/1.1\r\n\r\nhi", "<p>é</p>", "abc", "abc"]
    rows = [(i, f"http://h/{i}\r\nX: y" if i else None, h, "other") for i, h in enumerate(html)] + [(6, "again", "<p>é</p>", "o")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    top = {}
    for i, _, h, _ in rows:
        top[h or ""] = max(top.get(h or "", -1), i)
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        again = len(b) >= least and i != top[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top[h or ""] if again else None))
    same(warc.round_trip(pages, least=least), want, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    chunks = warc.read(warc.write(pages, common.scratch(spark, "w"), least)).where("page_id = 4").orderBy("chunk_no").collect()
    assert len(chunks) > 1 and max(len(c["chunk"]) for c in chunks) <= warc.CHUNK and b"".join(bytes(c["chunk"]) for c in chunks).decode() == html[4]
    assert warc.round_trip(pages.limit(0)).count() == 0


def base_pii(t):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    for order, (kind, pattern, ok) in enumerate([
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t or "") if ok(m[0])]
    return [s for _, _, s in sorted(out)]


def test_pii(docs, empty):
    tagger = pii.Tagger().fit(pii.made_windows(400), epochs=4)
    got = pii.find(docs, tagger)
    want = [(r[0], *(sum(s.startswith(k) for s in base_pii(r[1])) for k in pii.KINDS), sha(",".join(base_pii(r[1])))) for r in ROWS]
    same(got, want, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"])
    assert pii.find(empty, tagger).count() == 0
    for _ in range(300):  # random texts of the patterns' characters
        t = "".join(R.choice("a.@+1234567890 ()-_é") for _ in range(R.randint(0, 60)))
        assert [f"{k}:{a}:{b}" for k, a, b in pii.exact(t)] == base_pii(t)


def test_emails_without_digits_are_read(spark):
    mails = ["jane.doe (at) mail.example.org", "jane.doe[at]post.example[dot]com", "mara (at) example (dot) net", "tom_field(at)mail.example.org"]
    texts = [f"{'plain words of a text without numbers ' * k}please write to {m} for more of it" for m in mails for k in (0, 1, 20)]
    df = spark.createDataFrame([*enumerate(texts), (99, "we meet (at) noon and leave [at] dusk, no more")], "doc_id long, text string")
    got = {r["doc_id"]: r["added"] for r in pii.find(df, pii.Tagger().fit(pii.made_windows())).collect()}
    want = {i: f"email:{t.index(m)}:{t.index(m) + len(m)}" for i, (t, m) in enumerate((t, m) for t in texts for m in mails if m in t)}
    assert sum(got[i] == w for i, w in want.items()) >= 10 and got[99] == ""


def test_tagger_gradient_and_accuracy():
    import numpy as np

    t = pii.Tagger()
    ids, tags = (np.array(x) for x in zip(*pii.made_windows(6, 2)))

    def loss():
        e, _ = t.emissions(ids)
        z, gold = e[:, 0] + t.p["s"], e[np.arange(len(ids)), 0, tags[:, 0]] + t.p["s"][tags[:, 0]]
        for i in range(1, e.shape[1]):
            z = np.log(np.exp(z[:, :, None] + t.p["T"]).sum(1)) + e[:, i]
            gold = gold + e[np.arange(len(ids)), i, tags[:, i]] + t.p["T"][tags[:, i - 1], tags[:, i]]
        return (np.log(np.exp(z).sum(1)) - gold).mean()

    grads = t.step(ids, tags)
    for name in t.p:
        where = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        t.p[name][where] += 1e-5
        up = loss()
        t.p[name][where] -= 2e-5
        down = loss()
        t.p[name][where] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][where]) < 1e-3 * max(1, abs(grads[name][where]))
    trained = pii.Tagger().fit(pii.made_windows(600), epochs=6)
    x, y = (np.array(v) for v in zip(*pii.made_windows(150, 77)))
    assert (trained.decode(x) == y).mean() > 0.97


def brute_contaminated(t):
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))
    w = words(t)
    hit, items = set(), set()
    for item, b in BENCH:
        v = words(b)
        for p in {tuple(v[i : i + 13]) for i in range(max(1, len(v) - 12))} if v else ():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    items |= {item} - {None}
    return len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [500_000, 5])
def test_decontamination(spark, docs, empty, block):
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    same(decontam.decontaminate(docs, bench, block_words=block), [(r[0], *brute_contaminated(r[1])) for r in ROWS], cols)
    assert decontam.decontaminate(empty, bench).count() == 0 and decontam.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_fm_index_finds_all():
    import numpy as np

    seq = np.array([R.randint(0, 3) for _ in range(500)])
    index = decontam.FMIndex(seq, 4)
    for p in itertools.product(range(4), repeat=3):
        a, b = index.search(np.array([p]), np.array([3]))
        assert sorted(index.locate(np.arange(a[0], b[0])).tolist()) == [i for i in range(498) if tuple(seq[i : i + 3]) == p]


def test_lm_scores(docs, empty, spark):
    for frame, head in ((docs, 60_000), (docs, 3)):  # with so small a head, most words come through the join
        got = lm.score(frame, head=head, short=2).collect()
        held = lambda i: __import__("zlib").crc32(("" if i is None else str(i)).encode()) % 5 == 1
        toks = lambda t: [*ws(low(t)), "\n"]
        c = Counter(w for r in ROWS if not held(r[0]) for w in toks(r[1]))
        n, v = sum(c.values()), len(c)
        want = [(r[0], held(r[0]), len(toks(r[1])), sum(c[w] > 0 for w in toks(r[1])), n, round(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(r[1])), 6)) for r in ROWS]
        assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))) for r in got)
        assert all(r["score"] < 0 for r in got)
    assert lm.score(empty).count() == 0


def test_lm_probabilities_sum_to_one():
    import numpy as np

    table = lm.fit([(i * 5 + j, 1 + i * j) for i in range(5) for j in range(5)], 5, steps=200)
    assert np.allclose((10**table).sum(1), 1)
    counts = np.array([[1 + i * j for j in range(5)] for i in range(5)])
    share = counts / counts.sum(1, keepdims=True)
    assert np.abs(10**table - share)[1:].max() < 0.12


def brute_fingerprint(t):
    w = ws(low(t))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(list(root), 2):
        if bin(a ^ b).count("1") <= 2:
            root[find(a)] = find(b)
    return {f: find(f) for f in root}


def test_near_duplicates(docs, empty):
    fps = [brute_fingerprint(r[1]) for r in ROWS]
    group = groups(set(fps))
    top = {}
    for f, r in zip(fps, ROWS):
        if r[0] is not None:
            top[group[f]] = min(top.get(group[f], 1 << 60), r[0])
    same(simhash.near_duplicates(docs), [(r[0], f"{f:016x}", top[group[f]]) for f, r in zip(fps, ROWS)], ["doc_id", "fingerprint", "component_id"])
    assert simhash.near_duplicates(empty).count() == 0


def test_links_connect_dense_and_chained_fingerprints(spark):
    base = [R.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base[:3]:  # a dense cluster, a chain, pairs
        fps |= {b ^ 1 << i for i in range(0, 64, 3)} | {b ^ 1 << i ^ 1 << (i + 7) for i in range(20)}
        x = b
        for i in range(0, 40, 2):
            x ^= 3 << i
            fps.add(x)
    fps |= {b ^ 5 for b in base[3:]} | {R.getrandbits(64) for _ in range(200)} | {base[4] ^ 0xFF}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = [tuple(r) for r in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in edges)
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    root = {r["node"]: r["root"] for r in got}
    want = groups(fps)
    parts = {}
    for f, g in want.items():
        parts.setdefault(g, set()).add(signed(f))
    for part in parts.values():
        assert {root.get(f, f) for f in part} == {min(part)}


@pytest.mark.parametrize("block", [similar.BLOCK_SHINGLES, 2000])
def test_no_partner_is_lost_in_a_large_bucket(spark, monkeypatch, block):
    """All texts share a long passage, no two of different pairs are similar, and the texts of a pair are hardly nearer to each other than to all others."""
    monkeypatch.setattr(similar, "BLOCK_SHINGLES", block)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    passage = " ".join(word() for _ in range(104))
    own = lambda n: " ".join(word() for _ in range(n))
    texts = []
    for _ in range(150):
        shared = own(4)
        texts += [f"{passage} {shared} {own(10)}" for _ in range(2)]
    sets = [set(simhash.hashes(t.encode(), similar.SHINGLE).tolist()) for t in texts]
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert alike == [(i + 1, i) for i in range(0, len(texts), 2)]
    order = list(range(len(texts)))
    r.shuffle(order)
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, similar.near_copies(docs).select("doc_id", "component_id").collect()))
    assert got == [(i, i - i % 2) for i in range(len(texts))]



@pytest.mark.parametrize("crowded", [64, 3])
def test_near_copies_of_the_pipeline(spark, monkeypatch, crowded):
    import corpus_pipeline as p

    monkeypatch.setattr(similar, "CROWDED", crowded)
    r = random.Random(8)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    texts = []
    for i in range(12):  # copies of 100 to 300 words with up to six words changed, some beyond 0.8, and chains
        w = words(r.randint(100, 300))
        texts.append(" ".join(w))
        for _ in range(4):
            v = list(w)
            for _ in range(r.randint(1, 6)):
                v[r.randrange(len(v))] = "new"
            texts.append(" ".join(v))
            w = v if i % 2 else w
    texts += [texts[0].upper(), None, "", "two words", "Two  words", *(" ".join(words(50)) for _ in range(20))]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (ws(low(t)) for t in texts)]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            low_, high = sorted((root[a], root[b]))
            root = [low_ if x == high else x for x in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    if crowded == 64:
        assert {x["doc_id"] for x in p.drop_near_duplicates(spark, docs, "").collect()} == set(root)
    else:
        assert sorted(map(tuple, similar.near_copies(docs).select("doc_id", "component_id").collect())) == list(enumerate(root))


def test_quality_classifier(spark, docs, empty):
    clean = lambda: " ".join(R.choice(["alpha", "beta", "gamma", "delta", "zeta"]) for _ in range(60))
    made = [(i, clean() + (" foulword" if i % 5 == 0 else "")) if i % 7 else (i, "### $$$ %%% " * 30) for i in range(400)]
    labels = [(i, int(i % 7 != 0), int(i % 5 == 0 and i % 7 != 0)) for i in range(0, 400, 2)] + [(0, 0, 0), (None, 1, 1), (9999, 1, None)]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    model = quality.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["kept"] for r in quality.classify(frame, model).collect()}
    wrong = [i for i, t in made if got[i] != (i % 7 != 0 and i % 5 != 0)]
    assert not wrong
    odd = quality.classify(docs, model, docs.columns, ("_score", "_kept"))
    assert odd.columns == [*docs.columns, "_score", "_kept"] and not odd.where("doc_id < 3 and _kept").head(1) and odd.count() == len(ROWS)
    assert quality.classify(empty, quality.train(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_weak_labels_recover_accuracies():
    import numpy as np

    r = np.random.default_rng(0)
    y = r.random(4000) < 0.3
    v = np.stack([np.where(r.random(4000) < a, y, ~y).astype(int) for a in (0.9, 0.8, 0.7, 0.85)], 1)
    post, hit, ok = quality.weak_labels(v)
    assert ((post > 0.5) == y).mean() > 0.9 and np.abs(hit - [0.9, 0.8, 0.7, 0.85]).max() < 0.06


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    clean = lambda: " ".join(R.choice(["alpha", "beta", "gamma", "delta", "the", "of", "and", "pi", "rho"]) for _ in range(80))
    rows = [(i, clean(), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(50, rows[3][1], "en", "s1", 0), (51, "$$$ ### " * 40, "en", "s1", 0), (52, clean() + " " + BENCH[0][1], "en", "s1", 0), (53, clean() + " token=abcdef123456 " + clean(), "en", "s2", 0), (54, None, None, None, None), rows[5]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(51, 0, 0), *[(i, 1, 0) for i in range(30)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in p.STAGES:
        docs = common.stored(stage(spark, docs, str(tmp_path)), "stage")
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(kept[0]) == set(range(40)) | {50, 52, 53} and set(kept[1]) == set(range(40)) | {52, 53} and set(kept[2]) == set(range(40)) | {53}
    assert "[REDACTED]" in kept[3][53] and "abcdef123456" not in kept[3][53] and set(kept[3]) == set(kept[2])
    whole = p.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in whole.collect()} == set(kept[4]) <= set(kept[3])
