"""Operators against libraries, brute force, round trips and held-out rows, on small fixtures with the odd cases."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import public_tokenizers as P
from mapweave.llm import bbpe, embed_dedup, imatch, jaccard_join, langid, mixing, pii, quality, token_store, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_tokens string"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " ", "\n\n a  b\t\n", LONG, LONG, LONG.replace("kappa", "word", 1), "x" * 5000, "short", "\x1c odd \x85 space", "日本語 テスト 🙂 é́", "Mail to jo.7@mail1.example.com now", "it's 12 o'clock — don't!"]
    rows = [(k, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", 0, "clash", "clash") for k, t in enumerate(texts)]
    rows += [rows[4], (None, "no id", None, None, None, None, None)]
    return frame(spark, rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_byte_bpe_equals_the_library(spark, docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bbpe.load_ranks(path), special_tokens={})
    rows = docs.select("doc_id", "text").toPandas()
    got = bbpe.digests(docs, path, P.PATTERN).toPandas()
    assert len(got) == len(rows)
    want = sorted((hashlib.sha256(np.array(lib.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for t in rows["text"])
    assert sorted(zip(got["ids_sha256"], got["decoded_sha256"], strict=True)) == want
    c = bbpe.coder(path, P.PATTERN)
    for t in ("thththth" * 300, "a" * 999, "ünïcödé" * 40):
        assert list(c.transduce(t.encode())) == c.merge(t.encode()) if len(t) < 300 else b"".join(map(c.bytes_of.get, c.transduce(t.encode()))) == t.encode()
    assert bbpe.digests(empty(spark), path, P.PATTERN).count() == 0


def test_utf8_machine():
    raw = "aé日🙂".encode() + b"\xff\xe0\x80a\xc3"
    state, out = b"", ""
    for c in raw:
        state, text = bbpe.utf8_move(state, bytes([c]))
        out += text
    assert out + "�" * bool(state) == raw.decode("utf-8", "replace")


def test_token_store_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = token_store.token_digests(docs, P.path("word_bpe_49k.json"), 2).toPandas().sort_values("start")
    rows = docs.select("doc_id", "text").toPandas()
    want = sorted(zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for x in rows["text"])
    assert sorted(got["ids_crc32"]) == want
    assert (got["start"].to_numpy() == np.concatenate([[0], got["n_tokens"].cumsum()[:-1]])).all()
    assert got["doc_id"].dropna().is_monotonic_increasing
    assert token_store.token_digests(empty(spark), P.path("word_bpe_49k.json"), 2).count() == 0


def test_token_store_added_tokens():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, texts = Tokenizer.from_file(path), ["a <|endoftext|> b", "x<|startoftext|>y\n<|endoftext|>", "A <|ENDOFTEXT|> é́ b", "plain <| text |>", "", None, LONG]
    assert t.encode(texts[0], add_special_tokens=False).ids == [320, 49407, 321]
    assert token_store.encoder(path).encode(texts) == [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_warc(spark):
    rows = [(1, "u1", "<p>same</p>"), (2, "u2", "<p>same</p>"), (3, None, None), (4, "u\n4", ""), (5, "u5", "é" * 9000), (None, "u6", "<p>same</p>"), (1, "u1", "<p>same</p>")]
    got = warc.round_trip(frame(spark, rows, "page_id long, url string, html string")).toPandas()
    by = {r.page_id: r for r in got.itertuples() if pd.notna(r.page_id)}
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert len(got) == 7
    assert (by[1].record_type, by[2].record_type, by[2].refers_to) == ("response", "revisit", 1)
    assert by[4].refers_to == 3 and by[3].payload_digest == sha(b"") and by[5].payload_bytes == 18000
    assert got[got.page_id.isna()].record_type.item() == "revisit"
    assert all(by[p].payload_digest == sha((h or "").encode()) for p, _, h in rows if p)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).count() == 0


def brute_components(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    x = base[rng.integers(0, 40, 600)] + rng.normal(size=(600, 16)) * 0.25
    label = [None if k % 50 == 0 else int(k % 2) * int(k % 3 > 0) for k in range(600)]
    rows = [(k, [float(v) for v in x[k]], label[k]) for k in range(600)]
    rows[7] = (7, None, 1)
    rows[8] = (8, [0.0] * 16, 1)
    rows[9] = (9, [float("nan")] + [1.0] * 15, 1)
    rows[10] = (10, [None] + [1.0] * 15, 1)
    got = embed_dedup.near_duplicates(frame(spark, rows, "vec_id long, embedding array<double>, label int"), block=64).toPandas().set_index("vec_id").sort_index()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    ok = [k not in (7, 8, 9, 10) and label[k] is not None for k in range(600)]
    pairs = [(i, j) for i in range(600) for j in range(i + 1, 600) if ok[i] and ok[j] and label[i] == label[j] and unit[i] @ unit[j] >= 0.93]
    links = np.bincount([k for p in pairs for k in p], minlength=600)
    assert pairs and (got["n_links"].to_numpy() == links).all()
    assert got["component_id"].tolist() == brute_components(600, pairs)
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def near_copies():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(5000)]
    rows, k = [], 0
    for group in range(30):
        text = [words[i] for i in rng.integers(0, 5000, int(rng.integers(30, 300)))]
        for copy in range(40 if group == 0 else int(rng.integers(1, 5))):
            t = list(text)
            for p in rng.integers(0, len(t), int(copy % 5 * len(t) / 200)):
                t[p] = words[rng.integers(0, 5000)]
            rows.append((k, " ".join(t)))
            k += 1
    return [*rows, (k, rows[0][1].upper() + "!"), (k + 1, None), (k + 2, ""), (k + 3, "one two"), (k + 4, "One, two.")]


def test_jaccard_join_equals_brute_force(spark):
    rows = near_copies()
    got = jaccard_join.near_duplicates(frame(spark, rows, "doc_id long, text string"), max_docs=16).toPandas().set_index("doc_id").sort_index()

    def shingle(t):
        w = re.findall(r"\w+", (t or "").lower())
        return {tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingle(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    links = np.bincount([k for p in pairs for k in p], minlength=len(rows))
    assert len(pairs) > 300 and (got["n_links"].to_numpy() == links).all()
    assert got["component_id"].tolist() == brute_components(len(rows), pairs)
    one = jaccard_join.keep_one(frame(spark, [(i, t, "c") for i, t in rows], "doc_id long, text string, component_id string"))
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(got["component_id"]))


def test_jaccard_join_odd_rows(spark, docs):
    got = jaccard_join.near_duplicates(docs).toPandas()
    assert len(got) == docs.count()
    assert got[got.doc_id == 5].component_id.item() == 4
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0
    assert jaccard_join.keep_one(empty(spark)).count() == 0


def test_keep_one_of_repeated_ids(spark):
    words = LONG.split()[:24]
    text = [" ".join(f"{w}{k}" for w in words * 3) for k in range(5)]
    near = text[0].replace("kappa0", "word", 1)
    rows = [(3, text[0]), (7, text[1]), (7, text[2]), (7, text[2]), (7, text[0]), (7, near), (8, text[3]), (9, text[3]), (8, ""), (8, ""), (None, text[0])]
    got = jaccard_join.keep_one(frame(spark, rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(3, text[0]), (7, text[1]), (7, text[2]), (8, text[3]), (8, ""), (0, text[0])])


def test_depth_is_shortened_by_the_data(spark):
    assert jaccard_join.least_depth(0.8, 32, 0.9999, 9) == 6
    forest, rng = jaccard_join.Forest(32, 9), np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64)) for _ in range(60)]
    for change, depth in ((4, 9), (40, 6)):
        sets = base + [np.unique(np.concatenate([b[change:], rng.integers(0, 1 << 63, change, dtype=np.uint64)])) for b in base]
        classes = spark.createDataFrame([(k, forest.labels(s)) for k, s in enumerate(sets)], "rep long, labels binary")
        tries = jaccard_join._tries(classes, forest, 6)
        met = jaccard_join._stars(tries, 9).where("rep <> least").selectExpr("rep AS a", "least AS b").distinct()
        share = jaccard_join.expected_recall(classes, met, forest, 0.8, [9, 8, 7])
        assert next((d for d, x in share.items() if x >= 0.9999), 6) == depth
    assert jaccard_join.expected_recall(classes, met.limit(0), forest, 0.8, [9]) == {}


def test_tries_keep_what_shares_a_prefix(spark):
    forest, rng = jaccard_join.Forest(2, 3), np.random.default_rng(2)
    rows = [(k, rng.integers(0, 3, 6).astype("<u2").tobytes()) for k in range(40)]
    got = {(r.tree, r.rep) for r in jaccard_join._tries(spark.createDataFrame(rows, "rep long, labels binary"), forest, 2).collect()}
    node = lambda t, raw: (t, raw[6 * t : 6 * t + 4])
    every = [node(t, x) for t in (0, 1) for _, x in rows]
    assert {(t, k) for t in (0, 1) for k, x in rows if every.count(node(t, x)) > 1} <= got


def test_jaccard_recall_on_the_table(spark):
    """The links of all documents of sf0.001 against all pairs."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.n_links for r in jaccard_join.near_duplicates(frame(spark, rows, "doc_id long, text string")).collect()}
    sets = [set(zip(*(w[k : max(1, len(w) - 4) + k] for k in range(min(5, len(w)))), strict=False)) for w in (re.findall(r"\w+", (t or "").lower()) for _, t in rows)]
    want = [sum(1 for j, y in enumerate(sets) if j != i and x and y and len(x & y) >= 0.8 * len(x | y)) for i, x in enumerate(sets)]
    assert sum(want) > 20 and sum(got.values()) >= 0.999 * sum(want)


@pytest.mark.parametrize("text, kinds", [
    ("nt.\nThat.30@mail1.example.com bleou", ["email"]), ("to +1 (603) 555-8791 sh 190", ["phone"]), ("it 233.254.104.120.", ["ip"]),
    ("token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\"", ["secret"]), ("le 2123465659789240 eau", ["card"]), ("Dear Mrs. Anna Smith and Mr Jones", ["given-f", "family", "family"]),
    ("id 078-05-1120", ["ssn"]), ("DE89 3704 0044 0532 0130 00", ["iban"]), ("plain words, 12 of them: 1.2.3 = 4", []), (None, []), ("", []), ("@ a@b +1 ..@..", [])])
def test_detect(text, kinds):
    assert [k for _, _, k in pii.detect(text)] == kinds


@pytest.mark.parametrize("text, found", [
    ("Ask Dr. Anton Smith or Prof. Weber", [("Anton", "given-m"), ("Smith", "family"), ("Weber", "family")]), ("Prof. Dr. Anna Smith", [("Anna", "given-f"), ("Smith", "family")]),
    ("Mrs. Anna Smith came. Mrs. Smith left, Annabel", [("Anna", "given-f"), ("Smith", "family"), ("Smith", "family")]), ("Anna Smith sat. Dr. John Brown spoke; John", [("Anna", "given-f"), ("Smith", "family"), ("John", "given-"), ("Brown", "family"), ("John", "given-")]),
    ("Frau Anna Müller-Lüdenscheid, Miss Vera", [("Anna", "given-f"), ("Müller-Lüdenscheid", "family"), ("Vera", "given-f")]), ("603-555-8791 or 6035558791 or 6035558792", [("603-555-8791", "phone"), ("6035558791", "phone")]),
    ("a" * 90 + "@mail.example.com", [("a" * 90 + "@mail.example.com", "email")]),
    ("token" + " " * 40 + "= b44e15e09fd311c3cf31", [("b44e15e09fd311c3cf31", "secret")])])
def test_detect_whole_runs_and_mentions(text, found):
    assert [(text[a:b], k) for a, b, k in pii.detect(text)] == found
    assert not any(re.search(rf"(?<!\w){re.escape(e)}(?!\w)", pii.replace(text, pii.Surrogates(b"k"))[0]) for e, _ in found)


def test_surrogates_keep_shape_and_differ():
    make = pii.Surrogates(b"k")
    for kind, values in {"phone": [f"+1 ({k:03d}) 555-1234" for k in range(400)], "ip": [f"10.0.{k}.7" for k in range(200)], "email": [f"a{k}.b@mail.example.com" for k in range(300)],
                         "card": [f"4000 0000 0000 {k:04d}" for k in range(500)], "secret": [f"{k:040x}" for k in range(300)], "ssn": [f"078-05-{k:04d}" for k in range(300)]}.items():
        new = [make(kind, v) for v in values]
        assert len(set(new)) == len(values) and not any(a == b for a, b in zip(values, new, strict=True))
        shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"\d", "9", s)) if kind not in ("secret", "ip") else len(s.split("."))  # noqa: E731, B023
        assert all(shape(a) == shape(b) for a, b in zip(values, new, strict=True))
    assert make("ip", "10.1.2.3").startswith("10.")
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(make("phone", "+1 (603) 555-8791")) == digits(make("phone", "+1 603.555.8791"))
    luhn = make("card", "4111111111111111")
    assert pii._luhn(luhn[:-1]) == int(luhn[-1])
    iban = make("iban", "DE89370400440532013000")
    assert pii._iban_rest(iban[4:] + iban[:4]) == 1
    assert make("family", "Müller")[:1].isupper() and make("given-f", "Anna").split("-")[0] in pii.GIVEN["f"]
    one, two = make("family", "Müller-Lüdenscheid").split("-")
    assert (one, two) == (make("family", "Müller"), make("family", "Lüdenscheid"))
    assert {digits(make("phone", x))[-10:] for x in ("603-555-8791", "+16035558791", "+1 603 555 8791", "(603) 555-8791", "6035558791")} == {digits(make("phone", "603-555-8791"))}
    for low, n in (("192.168.", 65536), ("169.254.", 65536), ("172.20.", 65536), ("10.9.", 65536), ("8.8.", 65536)):
        new = {make("ip", f"{low}{k >> 8}.{k & 255}") for k in range(0, n, 97)}
        assert len(new) == len(range(0, n, 97)) and all(pii._ip_fixed(int.from_bytes(bytes(map(int, x.split("."))), "big")) == pii._ip_fixed(int.from_bytes(bytes(map(int, f"{low}0.0".split("."))), "big")) for x in new)
    ibans = [f"DE{c:02d}370400440532{k:06d}" for c in range(100) for k in range(40)]
    assert len({make("iban", x) for x in ibans}) == len(ibans)


def test_distinct_entities_stay_distinct_over_the_table(spark):
    """Entities and surrogates of all documents, found again in the texts by their places."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    new = {r.doc_id: r for r in pii.pseudonymise(docs, b"k").collect()}
    of, back = {}, {}
    for r in docs.collect():
        at, out = 0, new[r.doc_id].text
        found = pii.detect(r.text)
        assert new[r.doc_id].n_entities == len(found)
        gaps = [r.text[(found[k - 1][1] if k else 0) : found[k][0]] for k in range(len(found))] if found else []
        for k, (x, y, kind) in enumerate(found):
            at += len(gaps[k])
            rest = r.text[y : found[k + 1][0]] if k + 1 < len(found) else r.text[y:]
            end = at + y - x if not kind.startswith(("given", "ip")) else out.index(rest, at + 1) if rest else len(out)
            e, s = (kind, r.text[x:y]), (kind, out[at:end])
            assert of.setdefault(e, s) == s and back.setdefault(s, e) == e and e != s
            at = end
    assert len(of) > 50


def test_pii_collisions_and_clean_rows(spark):
    names = [(k, f"Here Mrs. {chr(65 + k % 26)}{'abcde'[k % 5]}{'xyz'[k // 26 % 3]}lle came, said Mrs. {chr(65 + k % 26)}{'abcde'[k % 5]}{'xyz'[k // 26 % 3]}lle.", "c") for k in range(60)]
    clean = [(100, "nothing here, 3 = 3", "c"), (101, None, "c"), (102, "", "c"), (None, "Mrs. Aaxlle", "c")]
    out = pii.pseudonymise(frame(spark, names + clean, "doc_id long, text string, n_entities string"), b"k").toPandas()
    got = {r.doc_id: r.text for r in out.itertuples() if pd.notna(r.doc_id)}
    new = [re.findall(r"Mrs\. ([\w-]+)", got[k]) for k in range(60)]
    old = [re.findall(r"Mrs\. ([\w-]+)", t)[0] for _, t, _ in names]
    assert all(a == b for a, b in new) and len({a for a, _ in new}) == len(set(old))
    assert [got[k] for k in (100, 101, 102)] == ["nothing here, 3 = 3", None, ""]
    assert out[out.doc_id.isna()].text.item() == f"Mrs. {new[0][0]}"
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), b"k").count() == 0


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join("w" * int(rng.integers(0, 60))), None if k % 7 == 0 else "abcdefgh"[k % 8] if k % 3 else "a") for k in range(900)]
    rows += [(None, "a b c", "a"), (5, rows[5][1], rows[5][2]), (1000, None, "z"), (1001, "", "z")]
    df = frame(spark, rows, "doc_id long, text string, source string")
    got, again = mixing.mix(df).toPandas(), mixing.mix(df).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    total = got["size"].sum()
    per = got.groupby(["target", "source_size"]).agg(taken=("taken", "sum")).reset_index()
    assert abs(per.target.sum() - 1.5 * total) < 1e-6 * total
    assert (per.target <= 2 * per.source_size + 1e-9).all() and (got.taken <= 2 * got["size"]).all()
    assert ((per.taken - per.target).abs() <= 30).all()
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_quality(spark):
    rng = np.random.default_rng(3)
    good = ["The " + " ".join("".join(rng.choice(list("abcdefg"), int(rng.integers(2, 9)))) for _ in range(60)) + "." for _ in range(150)]
    bad = [" ".join(w + "###" for w in g.split()) for g in good]
    rows = [(k, t, "x") for k, t in enumerate(good + bad)]
    df = frame(spark, [*rows, (900, None, "x"), (901, "", "x")], "doc_id long, text string, score string").drop("score")
    labels = frame(spark, [(k, int(k < 150)) for k in range(300)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = quality.score(df, quality.train(df, labels)).toPandas().set_index("doc_id")
    assert ((out.loc[range(300), "score"] >= 0.5).to_numpy() == (np.arange(300) < 150)).mean() > 0.97
    assert out["score"].between(0, 1).all()
    bare = quality.train(df, labels.limit(0))
    assert quality.score(df, bare).where("score < 0.49 or score > 0.51").count() == 0
    m = quality.fit(np.array([[0.0], [1.0]] * 100), np.array([0.0, 1.0] * 100), trees=20)
    assert m.score(np.array([[0.0], [1.0]])).round().tolist() == [0, 1]


def test_language(spark):
    rng = np.random.default_rng(4)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(40))
    rows = [(k, make("abcdef") if k % 2 else make("mnopqé"), "x" if k % 2 else "y") for k in range(200)]
    df = frame(spark, [*rows, (500, None, "x"), (501, "12 !?", None), (502, "", "y"), (None, "abc fed", None)], "doc_id long, text string, lang string")
    got = langid.predict(df, langid.train(df)).toPandas().set_index("doc_id")
    assert (got.loc[range(200), "lang_pred"].to_numpy() == np.where(np.arange(200) % 2, "x", "y")).all()
    assert got.loc[[500, 501, 502], "lang_pred"].tolist() == ["und"] * 3 and got["score"].between(0, 1).all()
    assert langid.predict(df, {}).where("lang_pred <> 'und'").count() == 0


def test_rare_language_is_learned(spark):
    rows = [(k, "abc fed cab", "x") for k in range(60)] + [(k, "mno qpm onm", "y") for k in range(60, 66)]
    assert set(langid.train(frame(spark, rows, "doc_id long, text string, lang string"), sample=2)) == {"x", "y"}


def test_fingerprints(spark, docs):
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(f"t{int(v)}" for v in rng.zipf(1.3, 200) % 500), None, None, None, None, None) for k in range(100, 140)]
    df = docs.unionByName(frame(spark, rows, DOCS))
    got = imatch.compare_edits(df).toPandas()
    assert len(got) == df.count()
    texts = sorted(((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.text or "") for r in df.toPandas().drop_duplicates(["doc_id", "text"]).itertuples()), reverse=True)
    for k, (i, t) in enumerate(texts):
        nxt, half = texts[(k + 1) % len(texts)][1], len(t) // 2
        row = got[got.doc_id == i].iloc[0] if i >= 0 else got[got.doc_id.isna()].iloc[0]
        assert row.n_chars == len(t) and row.edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
    same = got[got.doc_id.isin([4, 5])]
    assert same.fingerprint.nunique() == 1
    assert got.near_edited.between(0, 1).all() and got.near_edited.mean() > got.near_next.mean()
    assert imatch.compare_edits(empty(spark)).count() == 0


def test_fingerprints_equal_brute_force(spark, docs):
    import regex
    import xxhash

    rng = np.random.default_rng(11)
    rows = [(k, " ".join(f"T{int(v)}" for v in rng.zipf(1.2, int(rng.integers(0, 300))) % 700), None, None, None, None, None) for k in range(100, 220)]
    df = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(frame(spark, rows, DOCS))
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    words = lambda t: {w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}
    seen = Counter(w for t in texts.values() for w in words(t))
    band = {w for w, n in seen.items() if max(2, 0.01 * len(texts)) <= n <= 0.25 * len(texts)}

    def number(s):
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        return h - (1 << 64) if h >> 63 else h

    def prints(t):
        used = sorted(words(t) & band or words(t))
        groups = [[w for w in used if number(w) % 32 == i] for i in range(32)]
        groups += [[w for w in used if (number(w) >> 40) % 16 == 0 and (number(w) >> 20) % 16 == i] for i in range(16)]
        return [f"{number(' '.join(g)) % (1 << 64):x}" if g else "-" for g in groups]

    def near(a, b):
        either = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != ("-", "-")]
        return sum(x == y for x, y in either) / len(either) if either else 1.0

    order, got = sorted(texts, reverse=True), {r["doc_id"]: r for r in imatch.compare_edits(df).collect()}
    assert set(got) == set(texts) and 50 < len(band) < len(seen)
    for k, i in enumerate(order):
        t, follow = texts[i], texts[order[(k + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (".".join(prints(t)), ".".join(prints(edited)))
        assert got[i]["near_edited"] == pytest.approx(near(prints(t), prints(edited)))
        assert got[i]["near_next"] == pytest.approx(near(prints(t), prints(follow)))


def test_components_of_long_paths(spark):
    from mapweave.llm.components import connected_components

    edges = [(k, k + 1) for k in range(0, 400)] + [(1000, k) for k in range(1001, 1300)] + [(7000, 7000), (None, 3)]
    got = {r.id: r.component for r in connected_components(frame(spark, edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(401)) and all(got[k] == 1000 for k in range(1000, 1300)) and 7000 not in got


def test_decode_of_broken_sequences():
    c = bbpe.coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    byte = lambda *v: [c.ranks[bytes([x])] for x in v]
    for ids in (byte(0xE6, 0x97, 0xA5), byte(0xE6, 0x41, 0xC3), byte(0x41, 0xF0, 0x9F), byte(0xFF, 0xC3, 0xA9), []):
        assert c.decode(ids) == "".join(c.decode_stream(ids)) == c.decode_bytes(ids).decode("utf-8", "replace")


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage on odd rows, against its operator or a brute-force version."""
    import corpus_pipeline as C
    import tiktoken

    rng = np.random.default_rng(8)
    prose = [" ".join(f"w{int(v)}" for v in rng.integers(0, 900, 80)) for _ in range(60)]
    rows = [(100 + k, t, "en", f"s{k % 3}", len(t), "x", "y") for k, t in enumerate([*prose, prose[0], prose[1] + " end", prose[2] + " mail me@site.example.com"])]
    table = docs.unionByName(frame(spark, rows, DOCS))
    table.drop("n_tokens").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(200)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stage, sf = dict(C.STAGES), str(tmp_path)
    for name, f in C.STAGES:
        assert f(spark, empty(spark), sf).count() == 0, name
    kept = stage["quality"](spark, table, sf)
    assert kept.columns == C.COLUMNS and kept.count() == table.count()
    near = {r.doc_id for r in stage["near_duplicates"](spark, table, sf).collect()}
    assert {100, 101, 102} <= near and not {160, 161, 162} & near and 4 in near and not {5, 6} & near and {0, 1, 2, None} <= near
    clean = {r.doc_id: r for r in stage["pii"](spark, table, sf).collect()}
    assert "me@site" not in clean[162].text and clean[162].n_chars == len(clean[162].text) and clean[100].text == prose[0]
    mixed = pd.Series([r.doc_id for r in stage["mixing"](spark, table, sf).where("doc_id IS NOT NULL").collect()]).value_counts()
    want = mixing.mix(table).where("doc_id IS NOT NULL").groupBy("doc_id").agg({"epochs": "sum"}).toPandas().set_index("doc_id")["sum(epochs)"]
    assert mixed.to_dict() == want[want > 0].to_dict()
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bbpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in table.collect()}
    ids = stage["encoding"](spark, table, sf).collect()
    assert len(ids) == table.count() and all(list(r.ids) == lib.encode_ordinary(texts[r.doc_id] or "") and r.n_tokens == len(r.ids) for r in ids)
    assert C.run(spark, sf).count() > 0


def test_repeat_of_tied_rows(spark):
    rows = [(7, w, "a") for w in ("one two", "six ten", "abc def", "one two")] + [(8, "x y", "b"), (9, "z", "b"), (None, "q r", "b"), (10, None, "b")]
    df = frame(spark, rows, "doc_id long, text string, source string")
    key = lambda d: sorted((r[0] or 0, r[1]) for r in d.collect())
    got = key(mixing.repeat(df).groupBy("doc_id").count())
    assert got == key(mixing.mix(df).groupBy("doc_id").agg({"epochs": "sum"}).where("`sum(epochs)` > 0"))


def fair_targets(sizes, share=1.5, cap=2.0):
    """Round by round: the budget by weight, what is above a cap shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, got, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, share * sum(sizes.values())
    while len(got) < len(order):
        open_ = [s for s in order if s not in got]
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > cap * sizes[s]]
        if not full:
            return got | {s: unit * weight[s] for s in open_}
        for s in full:
            got[s] = cap * sizes[s]
            left -= got[s]
    return got


def test_mixing_targets_by_rounds(spark):
    rng = np.random.default_rng(9)
    for _ in range(3):
        names = [None, *"abcdefg"][: int(rng.integers(2, 9))]
        rows = [(k, " ".join("w" * int(rng.integers(0, 90) ** 2 // (1 + 20 * (k % 3)))), names[int(rng.integers(0, len(names)))]) for k in range(300)]
        sizes: dict = {}
        for _, t, s in rows:
            sizes[s] = sizes.get(s, 0) + len(t.split())
        src = {k: s for k, _, s in rows}
        want = fair_targets(sizes)
        for r in mixing.mix(frame(spark, rows, "doc_id long, text string, source string")).collect():
            assert r.target == pytest.approx(want[src[r.doc_id]]) and r.source_size == sizes[src[r.doc_id]]


def test_clashing_columns(spark, docs):
    model = quality.train(docs.drop("score"), spark.createDataFrame([], "doc_id long, quality int"))
    scored = quality.score(docs, model)
    assert scored.columns.count("score") == 1 and dict(scored.dtypes)["score"] == "double"
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = bbpe.encode_column(docs.withColumn("ids", docs["text"]).withColumn("decoded", docs["text"]), path, P.PATTERN)
    assert all(r.decoded == (r.text or "") for r in bbpe.decode_column(enc, path, P.PATTERN).collect())


def test_long_texts(spark):
    """Megabytes in one text, with and without white space."""
    from tokenizers import Tokenizer

    long = [("ab cd, it's 12 " * 150_000), "x" * 300_000]
    path = P.path("word_bpe_49k.json")
    t, got = Tokenizer.from_file(path), token_store.encoder(path).encode(long)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in long]
    c = bbpe.coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert all(c.decode(np.frombuffer(c.encode(x), "<u4").tolist()) == x for x in long)
    assert np.isfinite(quality.features(long[0])).all() and langid.bundle(long).any(axis=1).all() and pii.detect(long[0]) == []
