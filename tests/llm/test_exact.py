"""Operators held against brute force on small documents."""

import hashlib
import re
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash

from cases import documents, frame
from tessera.llm import contamination, fingerprints, licenses, lines, mixing, quality, registry, simhash, substrings, token_files, urls


def got(df) -> dict:
    rows = [r.asDict() for r in df.collect()]
    out = {r[df.columns[0]]: r for r in rows}
    assert len(out) == len(rows)
    return out


def canonical(text):
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split())


@pytest.mark.parametrize("bits", [128, 8])
def test_fingerprints(spark, bits):
    rows = sorted(documents(), key=lambda r: r[0])
    out = got(fingerprints.fingerprints(frame(spark, rows), digest_bits=bits))
    assert len(out) == len(rows)
    text = [r[1] or "" for r in rows]
    for i, r in enumerate(rows):
        after = text[(i + 1) % len(rows)]
        cut = len(text[i]) // 4
        edited = text[i][: len(text[i]) - cut] + after[:cut]
        o = out[r[0]]
        assert o["n_chars"] == len(text[i])
        assert o["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert o["near_edited"] == float(canonical(edited) == canonical(text[i]))
        assert o["near_next"] == float(canonical(after) == canonical(text[i]))
        assert o["group_id"] == min(s[0] for s in rows if canonical(s[1] or "") == canonical(text[i]))
        if bits == 128:
            assert o["edited_fingerprint"] == xxhash.xxh3_128_hexdigest(canonical(edited).encode())
    for a in rows:
        for b in rows:
            assert (out[a[0]]["fingerprint"] == out[b[0]]["fingerprint"]) == (canonical(a[1] or "") == canonical(b[1] or ""))


def brute_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values: dict, radius=4):
    ids = sorted(values)
    component = {i: i for i in ids}

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = root(i), root(j)
                component[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("chunk", [8192, 5])
def test_simhash(spark, chunk):
    rows = documents()
    out = got(simhash.near_duplicates(frame(spark, rows), chunk=chunk))
    values = {r[0]: brute_simhash(r[1]) for r in rows}
    want = brute_components(values)
    assert {i: (o["fingerprint"], o["component_id"]) for i, o in out.items()} == {i: (f"{values[i]:016x}", want[i]) for i in values}


@pytest.mark.parametrize("chunk", [8192, 64])
def test_simhash_dense_groups(spark, chunk):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 4, dtype=np.uint64)
    values = {int(c) for c in centres}
    for c in centres:
        for _ in range(150):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
            values.add(x)
    signed = [int(np.uint64(v).astype("int64")) for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), chunk=chunk).collect()
    assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 4 for r in links)
    want = brute_components({v: v & (2**64 - 1) for v in signed})
    parent = {v: v for v in signed}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for r in links:
        parent[max(root(r["a"]), root(r["b"]))] = min(root(r["a"]), root(r["b"]))
    assert {v: root(v) for v in signed} == want


def brute_repeats(rows, window=13):
    texts = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows}
    first = {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - window + 1):
            first.setdefault(tuple(texts[i][p : p + window]), i)
    out = {}
    for i, w in texts.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [13, 7, 20])
def test_substrings(spark, window):
    rows = documents()
    out = got(substrings.remove_repeats(frame(spark, rows), window=window))
    want = brute_repeats(rows, window)
    assert sum(w[1] for w in want.values()) > 100
    assert {i: (o["n_words"], o["n_removed"], o["kept_sha256"]) for i, o in out.items()} == want


def test_substrings_of_rows_with_one_id_or_none(spark):
    """Two thirds of the rows have no id or the same one: they lose what a smaller id has, and nothing to each other."""
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else r[0], *r[1:]) for i, r in enumerate(documents())]
    found = substrings.remove_repeats(frame(spark, rows)).collect()
    last = 1 << 62
    starts: dict[tuple, int] = {}
    for r in rows:
        w = (r[1] or "").encode().split()
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            starts[key] = min(starts.get(key, last), last if r[0] is None else r[0])
    want = []
    for r in rows:
        w = (r[1] or "").encode().split()
        gone = {k + j for k in range(len(w) - 12) if starts[tuple(w[k : k + 13])] < (last if r[0] is None else r[0]) for j in range(13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((str(r[0]), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert sum(n for i, _, n, _ in want if i in ("None", "50")) > 50
    assert sorted((str(o["doc_id"]), o["n_words"], o["n_removed"], o["kept_sha256"]) for o in found) == sorted(want)


def test_lines(spark):
    rows = documents()
    out = got(lines.drop_shared_lines(frame(spark, rows)))
    keys = {}

    def key(x):
        return re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))

    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            keys.setdefault(k, set()).add(r[0])
    dropped = 0
    for r in rows:
        own = (r[1] or "").split("\n")
        kept = [x for x in own if not (len(key(x)) >= 40 and len(keys[key(x)]) >= 5 and max(keys[key(x)]) != r[0])]
        dropped += len(own) - len(kept)
        o = out[r[0]]
        assert (o["n_lines"], o["n_dropped"], o["kept_text"]) == (len(own), len(own) - len(kept), "\n".join(kept))
    assert dropped >= 7


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short one"), (3, None), (4, " "), (5, "one two three four five six"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")]


@pytest.mark.parametrize("mb", [8, 0])
def test_contamination(spark, mb):
    filler = "x y z " * 50
    item = ITEMS[0][1].split()
    docs = [(1, filler + ITEMS[0][1].upper() + "! " + filler), (2, " ".join(item[:11])), (3, " ".join(item[:9])), (4, "a Short, one."), (5, None), (6, ""), (7, filler), (8, "zero one two three four five"), (9, " ".join([*item[:6], "noise", *item[6:]])), (1, ITEMS[0][1])]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items, broadcast_mb=mb).collect()

    def grams(text, n):
        w = re.sub(r"[!-/:-@\[-`{-~]", "", text.lower()).split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = set()
    for d, text in docs:
        for i, t in ITEMS:
            if t and t.split():
                own = grams(t, min(5, len(t.split())))
                hits = len(own & grams(text or "", min(5, len(t.split()))))
                if hits >= 0.8 * len(own):
                    want.add((d, i, len(own), hits))
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in out} == want
    assert {d for d, *_ in want} == {1, 2, 4}


def test_licenses(spark):
    mit = dict(licenses.LICENSES)["MIT"]
    docs = [(1, mit), (2, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(",", " ,")), (3, "x\nreleased under the M.I.T. licence\nLicensed under CC BY-NC 4.0"), (4, "Released under the MIT Licence!"), (5, None), (6, ""), (7, mit + " more")]
    out = got(licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {i: (o["license"], o["notices"]) for i, o in out.items()} == {1: ("MIT", None), 2: ("MIT", None), 3: (None, "CC-BY-NC-4.0"), 4: (None, "MIT"), 5: (None, None), 6: (None, None), 7: (None, None)}
    assert out[5]["digest"] == out[6]["digest"] == hashlib.md5(b"").hexdigest()


def test_urls(spark):
    rules = [*registry.URL_RULES, ("a.example.com", "", "block"), ("com", "", "allow")]
    given = [None, "", "no scheme", "http://com/en/1", "http://EXAMPLE.com/en/71?x", "https://b.example.com/en/8", "http://x.a.example.com", "http://notexample.net/de/8", "ftp://example.net/de/81#f", "http://net/de", "http://org/es/", "http://a.b.org?/es/", "http://x.org/es/#/", "http:///en/", "x://y://com/en/"]
    pages = [(i, u) for i, u in enumerate(given * 3)] + [(1000 + i, "http://hot.example.com/en/7") for i in range(300)]
    out = got(urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")))
    assert len(out) == len(pages)
    for i, u in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0]), len(r[1])), default=None)
        o = out[i]
        assert (o["host"], o["path"], o["rule"], o["verdict"]) == (host, path, best and best[0] + best[1], best[2] if best else "allow")


def test_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = sorted(documents(), key=lambda r: r[0])
    tokenizer = Tokenizer.from_file(registry.tokenizer_path())
    files = token_files.write_tokens(frame(spark, rows), registry.tokenizer_path(), f"file://{tmp_path}/t", length=64, batch_sequences=4)
    out = got(token_files.read_tokens(files, f"file://{tmp_path}/t"))
    start, stream = 0, []
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        o = out[r[0]]
        assert (o["start"], o["n_tokens"], o["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    read = []
    for f in sorted(files.collect()):
        held = token_files.TokenFile(f"file://{tmp_path}/t", f["path"])
        for k in range(-(-f["n_ids"] // 64)):
            ids, mask = held.sequence(k)
            assert len(ids) == len(mask) == 64
            read += ids[mask].tolist()
    assert read == stream


@pytest.mark.parametrize("most", [10, 1_000_000])
def test_encoder_matches_whole_texts(monkeypatch, most):
    import random

    monkeypatch.setattr(token_files, "PIECES", most)
    rng = random.Random(2)
    encode = token_files.Encoder(registry.tokenizer_path(), "<u2")
    pieces = [*"ab1 '\n\t .!s é  |\u00a0,", "word", "don't", "***", " x%%%", "\nÉté,", "'ll", "\u0600", "ß!?", "Ⅷ.", "_"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    for at in range(0, len(texts), 500):
        whole = encode.tokenizer.encode_batch(texts[at : at + 500], add_special_tokens=False)
        assert [np.frombuffer(x, "<u2").tolist() for x in encode(texts[at : at + 500])] == [w.ids for w in whole]
    if most == 10:
        assert len(encode.known) <= 2 + most


def brute_targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        out = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if out[s] > 3 * sizes[s]}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("block", [7, 1024])
def test_mixing(spark, block):
    rows = documents(90)
    rows += [rows[0]] * 2
    df = frame(spark, rows)
    mixed = mixing.mix(df, block_words=block)
    out = mixing.taken_words(mixed).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split(None) if r[1] and r[1].isascii() else re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = brute_targets(sizes)
    assert len(out) == len(rows)
    taken = {}
    source = {r[0]: r[3] for r in rows}
    for o in out:
        s = source[o["doc_id"]]
        assert o["source_size"] == sizes[s]
        assert o["target"] == pytest.approx(want[s])
        assert 0 <= o["taken"] <= 3 * o["size"]
        taken[s] = taken.get(s, 0) + o["taken"]
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= 1
    slots = [(r["slot"], r["words"]) for r in mixed.where("slot is not null").select("slot", "words").collect()]
    filled = {}
    for slot, n in slots:
        filled[slot] = filled.get(slot, 0) + n
    assert max(filled.values()) <= block and sum(n != block for n in filled.values()) <= len(sizes)


def test_mixed_documents(spark):
    rows = documents(90)
    df = frame(spark, rows)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    counts = {r["doc_id"]: r["taken"] for r in mixing.taken_words(mixing.mix(df)).collect()}
    have = {}
    for r in out.collect():
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert have == {i: n for i, n in counts.items() if n}


def test_quality_learns(spark):
    import random

    rng = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 80))]
        text = " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w) if i % 2 else " ".join([w[0]] * 40)
        docs.append((i, text))
        labels.append((i, int(good)))
    docs += [(1000, None), (1001, ""), (None, "a b c")]
    labels += [(None, 1), (5000, 0), (7, None)]
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = got(quality.classify(df, known))
    assert len(out) == len(docs)
    held = [i for i, y in labels[:600] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i]["held_out"] for i in held)
    assert sum(out[i]["predicted"] == labels[i][1] for i in held) >= 0.97 * len(held)
    assert all(0 <= o["score"] <= 1 and o["predicted"] == (o["score"] >= 0.5) for o in out.values())
    kept = quality.keep_good(df, known)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, o in out.items() if o["predicted"]}


def test_quality_without_labels(spark):
    out = quality.classify(spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert [r["score"] for r in out] == [0.5]


def test_discriminant_density():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(500, 3)), rng.normal(size=(300, 3)) * [1, 2, 0.5] + 1
    model = quality.Discriminant.from_moments([500, 300], [a.sum(0), b.sum(0)], [a.T @ a, b.T @ b], shrinkage=0.1)
    x = rng.normal(size=(5, 3))
    logits = []
    z = [(data - model.centre) / model.scale for data in (a, b)]
    own = [np.cov(d.T, bias=True) for d in z]
    pooled = (500 * own[0] + 300 * own[1]) / 800
    for c in (0, 1):
        few = 3 / (3 + len(z[c]))
        cov = (1 - few) * own[c] + few * pooled
        cov = 0.9 * cov + 0.1 * (np.trace(cov) / 3 + 1e-3) * np.eye(3)
        d = (x - model.centre) / model.scale - z[c].mean(0)
        logits.append(np.log(len(z[c])) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logits[0] - logits[1])))


OPERATORS = {
    "fingerprints": fingerprints.fingerprints,
    "simhash": simhash.near_duplicates,
    "one_of_each": simhash.one_of_each,
    "substrings": substrings.remove_repeats,
    "lines": lines.drop_shared_lines,
    "licenses": licenses.scan_licenses,
    "mix": lambda d: mixing.taken_words(mixing.mix(d)),
    "mixed": mixing.mixed_documents,
    "tokens": lambda d: token_files.token_index(d, registry.tokenizer_path()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_and_null_tables(spark, name):
    df = frame(spark, documents())
    assert OPERATORS[name](df.limit(0)).count() == 0
    odd = [(None, None, None, None, None, None, None, None)] * 3 + [(5, "same text here", "en", "a", 1, "", 1, "")] * 2 + [(5, "other", None, None, None, None, None, None), (None, "same text here", None, None, None, None, None, None)]
    n = OPERATORS[name](frame(spark, odd)).count()
    if name == "one_of_each":
        assert n == 3
    elif name != "mixed":
        assert n == len(odd)


def test_empty_and_odd_tables_of_pairs(spark):
    odd = [(None, None, None, None, None, None, None, None)] * 2 + [(5, "one two three four five six", "en", "a", 1, "", 1, "")] * 2 + [(None, "One, two three four five", None, None, None, None, None, None)]
    items = spark.createDataFrame([(1, "one two three four five"), (2, None), (None, "six")], "item_id long, text string")
    for mb in (8, 0):
        out = contamination.contaminated(frame(spark, odd), items, broadcast_mb=mb)
        found = {tuple(r) for r in out.select("doc_id", "item_id", "n_found").collect()}
        assert found == ({(5, 1, 1), (5, None, 1), (None, 1, 1)})
        assert contamination.contaminated(frame(spark, []), items, broadcast_mb=mb).count() == 0
        assert contamination.contaminated(frame(spark, odd), items.limit(0), broadcast_mb=mb).count() == 0
        left = contamination.decontaminate(frame(spark, odd), items, broadcast_mb=mb)
        assert left.columns == frame(spark, odd).columns
        assert [(r["doc_id"], r["text"]) for r in left.collect()] == [(None, None)] * 2
    rules = spark.createDataFrame(registry.URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(None, None, "x", "y"), (1, "http://com/en/", "x", None), (1, "http://com/en/", None, "y")], "page_id long, url string, host string, key string")
    assert sorted(r["verdict"] for r in urls.judge_urls(pages, rules).collect()) == ["allow", "block", "block"]
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert [r["rule"] for r in urls.judge_urls(pages, rules.limit(0)).collect()] == [None] * 3
    labels = spark.createDataFrame([(5, 1)], "doc_id long, quality int")
    assert quality.classify(frame(spark, []), labels).count() == 0
    assert quality.classify(frame(spark, odd), labels.limit(0)).count() == len(odd)
    assert quality.keep_good(frame(spark, odd), labels).columns == frame(spark, odd).columns
