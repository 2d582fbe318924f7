"""Cases that a reviewer found done in part."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from pointloom.llm import chat, common, decontam, langid, mixing, quality, secrets, shingles, simhash, substring, urlfilter

from . import brute


def test_near_copies_by_shingles(spark, sf):
    """All pairs at 0.8 or more are linked, those beyond three bits of a fingerprint too."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute.jaccard_components({r["doc_id"]: r["text"] for r in docs.collect()})
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == sorted(set(want.values()))


def test_near_copies_without_a_common_neighbour(spark):
    """A key's sets may be near copies of each other and not of the one that is compared first."""
    rounds, blocks = shingles.ROUNDS, shingles.BLOCK_SETS
    shingles.ROUNDS, shingles.BLOCK_SETS = 0, 5  # all pairs, in several blocks a key
    base = [f"w{k}" for k in range(400)]
    texts = {}
    for k in range(24):
        w = base.copy()
        for p in range(6 * (k // 4)):
            w[(p * 7 + 61 * (k // 4)) % 400] = f"x{k // 4}y{p}"
        w[k] = f"z{k}"
        texts[k] = " ".join(w)
    want = brute.jaccard_components(texts)
    got = simhash.drop_near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    shingles.ROUNDS, shingles.BLOCK_SETS = rounds, blocks
    assert 1 < len(set(want.values())) < 24 and {r["doc_id"] for r in got} == set(want.values())


def test_repeated_id_with_different_texts(spark):
    """A row only goes if its own group keeps another row."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (2, c, "y"), (2, c, "x"), (3, c, "x"), (4, d, "x"), (4, d, "x"), (None, b, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, simhash.drop_near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, a, "x"), (2, b, "x"), (2, c, "x"), (4, d, "x"), (None, b, "x")], key=repr)


def test_decontam_short_and_unspaced_items(spark):
    nine = "one two three four five six seven eight nine"
    chinese = "这是一个没有空格的句子用来测试"
    items = [(1, nine), (2, "zeta eta theta"), (3, chinese), (None, " ".join(f"n{k}" for k in range(20))), (4, "!?")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, nine.replace("five", "x")), (2, nine.replace("five", "x").replace("six", "y")), (3, "so zeta, ETA theta."), (4, "zeta eta"), (5, "前面" + chinese.replace("空格", "间隔") + "后面"), (6, items[3][1]), (7, "!?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.contamination(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (3, 2), (5, 3)]
    assert sorted(r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()) == [2, 4, 7]


def test_short_masks_tolerate_a_fifth():
    for n in range(1, decontam.LONG):
        gone = n - decontam.agreeing(n)
        for lost in combinations(range(n), gone):
            assert any(not set(m) & set(lost) for m in decontam.short_masks(n))


def test_whole_private_key_is_redacted(spark):
    line = "MIIEpAIBAAKCAQEA7bq3" + "Ab9/+" * 8
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n" + f"{line}\n" * 2000 + "q0w=\n-----END RSA PRIVATE KEY-----"
    pgp = f"-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: x\n\n{line}\n=aB3d\n-----END PGP PRIVATE KEY BLOCK-----"
    cut = f"-----BEGIN PRIVATE KEY-----\r\n{line}\r\n{line}\r\nq0w="
    quoted = "-----BEGIN PRIVATE KEY-----\\n" + f"{line}\\n" * 3 + "-----END PRIVATE KEY-----\\n"
    head = "-----BEGIN PRIVATE KEY-----"
    texts = [f"a {key} b", f"a {pgp} b", f"a {cut}\r\nplain words follow", f'"{quoted}"', f"{head} and words", f"{head}\n{line}\n{key} b", head * 20_000]
    want = ["a [SECRET] b", "a [SECRET] b", "a [SECRET]\r\nplain words follow", '"[SECRET]\\n"', "[SECRET] and words", "[SECRET]\n[SECRET] b", "[SECRET]"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in secrets.redact(docs).orderBy("doc_id").collect()] == want


def test_more_languages_than_a_block(spark):
    word = lambda k: "".join(chr(0x4E00 + 20 * k + j) for j in range(12))
    rows = [(2 * k + j, word(k), f"l{k:03}") for k in range(70) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in langid.identify(docs).collect())


def test_langid_scores_dont_depend_on_neighbours():
    model = langid.Model(["a", "b"], np.log(np.random.default_rng(1).dirichlet(np.ones(1 << langid.BITS), 2).T), np.log([0.5, 0.5]))
    texts = ["abc", "xyz abc", "q"]
    assert np.allclose(model.joint(texts), [model.joint([t])[0] for t in texts], rtol=0, atol=1e-9)


def test_budgets_keep_pairs_at_the_similarity():
    """Pairs of sets at 0.8 stay within the budgets of the pigeonring chains, and share a key."""
    rng = np.random.default_rng(11)
    lost = keyed = signed = 0
    for _ in range(300):
        n = int(rng.integers(40, 900))
        grams = rng.integers(0, 1 << 63, n + n // 4, dtype=np.uint64)
        drop = n // 9
        a, b = np.sort(grams[:n]), np.sort(np.r_[grams[drop:n], grams[n : n + drop]])
        assert 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        x = (shingles.fingerprint(a) ^ shingles.fingerprint(b)) & ((1 << 64) - 1)
        part = [(x >> 8 * k & 255).bit_count() for k in range(8)]
        chain = any(all(sum(part[(i + k) % 8] for k in range(m)) <= shingles.BUDGET * m // 8 for m in range(1, 9)) for i in range(8))
        assert chain == (x.bit_count() <= shingles.BUDGET)
        lost += not chain
        keyed += bool(set(shingles.band_keys(a)) & set(shingles.band_keys(b)))
        signed += (shingles.signature(a) == shingles.signature(b)).sum() >= shingles.AGREE
    assert lost <= 1 and keyed >= 299 and signed >= 299


def test_decontam_against_every_alignment(spark):
    """Items of all lengths, with substitutions, repeats and copies side by side, by brute force."""
    rng = np.random.default_rng(7)
    fresh = iter(range(10**6))
    items = [[f"i{k}t{j % 7 if k == 9 else j}" for j in range(n)] for k, n in enumerate((1, 2, 3, 4, 5, 7, 9, 10, 11, 20, 12, 13, 14, 30))]
    docs = []
    for item in items:
        for _ in range(6):
            words = [f"d{next(fresh)}" for _ in range(rng.integers(0, 9))]
            for copy in range(rng.integers(1, 4)):
                got = list(item)
                for at in rng.choice(len(got), min(len(got), int(rng.integers(0, 1 + max(1, len(got) // 4)))), replace=False):
                    got[at] = f"d{next(fresh)}"
                words += got + [f"d{next(fresh)}" for _ in range(rng.choice([0, 0, 1, 30]))]
            docs.append(words)
    docs.append(items[12] + items[9] * 3 + ["x"] + items[12][:12])
    bench = spark.createDataFrame([(f"q{k}", " ".join(w)) for k, w in enumerate(items)], "item_id string, text string")
    texts = spark.createDataFrame([(f"d-{k}", " ".join(w)) for k, w in enumerate(docs)], "doc_id string, text string")
    want = sorted((f"d-{d}", f"q{i}", *hit) for d, t in enumerate(docs) for i, a in enumerate(items) for hit in brute.overlaps(t, a))
    got = sorted(tuple(r) for r in decontam.contamination(texts, bench).collect())
    assert got == want and len({w[1] for w in want}) == len(items)


def test_decontam_of_equal_words():
    """Two texts of one repeated word have places x places hits, which are few alignments."""
    zeros = lambda n: np.zeros(n, np.uint64)
    assert decontam.verify(zeros(20_000), zeros(200), [(np.arange(19_990), np.arange(190))]) == [{"start": 0, "n_tokens": 20_000, "matches": 20_000}]


def test_ledger_scans_unseen_pairs_only(spark):
    """A known pair of blob and rule version isn't scanned again, whatever its pattern finds now."""
    rule = lambda kind, version, pattern: secrets.Rule(kind, version, pattern, 1)
    v1 = spark.createDataFrame([("a", "one two"), ("b", "one two"), ("c", "three")], "path string, text string")
    _, ledger, found = secrets.scan(v1, ["path"], rules=(rule("x", 1, "one"),))
    assert [tuple(r)[1:] for r in found.collect()] == [("x", 1, 0, 3)] and ledger.count() == 2
    v2 = spark.createDataFrame([("a", "one two"), ("d", "two one")], "path string, text string")
    rules = (rule("x", 1, "two"), rule("y", 1, "two"))
    paths, ledger, found = secrets.scan(v2, ["path"], ledger=ledger, findings=found, rules=rules)
    got = paths.join(found, "blob").select("path", "kind", "start")
    assert sorted(map(tuple, got.collect())) == [("a", "x", 0), ("a", "y", 4), ("d", "x", 0), ("d", "y", 0)]
    assert ledger.count() == 5 == ledger.distinct().count()  # the pair of "three" and y is still open


def test_secret_patterns_are_linear(spark):
    import time

    texts = ["eyJ" * 300_000, "eyJ" * 100_000 + "." + "eyJ" * 100_000, "-----BEGIN " * 50_000, "password" + " " * 500_000, "gh" * 300_000, "AKIA" * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    assert secrets.digest(docs).where("spans <> ''").count() == 1
    assert time.time() - began < 60


def test_redaction_of_many_secrets(spark):
    """A listing of hashes takes linear time; spans over block edges and astral characters are cut exactly."""
    import time

    b = secrets.BLOCK
    rng = np.random.default_rng(5)
    odd = "".join(rng.choice(["\U0001f600", "é", " x ", "a" * 40 + " ", "token=abcdefgh1234 ", "\n"], 4000))
    key = "-----BEGIN PRIVATE KEY-----\n" + ("Ab9/+" * 8 + "\n") * 300 + "-----END PRIVATE KEY-----"
    listing = "".join(f"{k:032x}  f{k}\n" for k in range(40_000))
    texts = [odd, "€" * (b - 8) + " " + key + "!", "0" * 32, "g" * (b - 32) + "0" * 32, "g" * (b - 1) + "0" * 32 + "AKIA" + "B" * 20, "plain", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in secrets.digest(docs).collect()}
    for r in secrets.redact(docs).collect():
        want, at = texts[r["doc_id"]], 0
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in found[r["doc_id"]].split(",") if s)
        out = []
        for lo, hi in spans:
            if lo > at or not out:
                out += [want[at:lo], "[SECRET]"]
            at = max(at, hi)
        assert r["text"] == ("".join(out) + want[at:] if spans else want)
    began = time.time()
    got = secrets.redact(spark.createDataFrame([(listing,)], "text string")).first()["text"]
    assert got == "".join(f"[SECRET]  f{k}\n" for k in range(40_000)) and time.time() - began < 60


def test_langid_thins_rows_of_one_id(spark):
    """Rows that share an id, or have none, are thinned like any others."""
    docs = spark.createDataFrame([(None, f"wort {chr(97 + k % 26)}{chr(97 + k // 26)}", "de") for k in range(600)], "doc_id long, text string, lang string")
    (model,) = langid.fit(docs, docs_per_lang=100)
    p = np.exp(model.log_prob[:, 0])
    total = 0.5 / p.min()  # the fit's n-grams with the smoothing's 0.5 a bucket
    rows = (total - 0.5 * len(p)) / (3 * len("wort aa   "))
    assert 50 < rows < 200


def test_turns_come_back_from_streamed_events(spark):
    """Deltas, regenerations and edits fold to the rows, repeated rows and equal turns included."""
    rows = [(1, 0, "user", "ß hi"), (1, 1, "assistant", "x" * 10_000 + "\U0001f600\n"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 1, "user", "b"), (2, 0, "assistant", None), (2, None, None, "z"), (None, 0, "user", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1))
    events = chat.events_of(table)
    assert {r["event"] for r in events.select("event").distinct().collect()} == {"message", "delta", "regenerate", "edit"}
    got = {}
    for r in chat.format_turns(events).orderBy("conv_id", "turn", "part").collect():
        got.setdefault(r["conv_id"], []).extend(chat.parse(r["formatted"]))
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert got == want
    cols = ("conv_id", "turn", "part", "formatted", "loss_start", "loss_end")
    kept = sorted(chat.format_turns(events, dealt=True).select(*cols).collect(), key=repr)
    assert kept == sorted(chat.format_turns(events).select(*cols).collect(), key=repr)
    assert chat.events_of(table.where("false")).count() == 0 and chat.format_turns(chat.events_of(table.where("false")), dealt=True).count() == 0


def test_training_is_ftrl():
    """Against a scalar loop over coordinates."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(60):
        text = " ".join(rng.choice(words[:25] if k % 3 else words[15:], 30))
        rows.append((*quality.features(text.encode()), int(k % 3 > 0)))
    model = quality.train(rows)
    size = 1 << quality.BITS
    z = np.array([model.weights[i] @ (quality.SCALE * c / c.sum()) for i, c, _ in rows]) + model.bias - model.shift
    assert np.allclose(1 / (1 + np.exp(-z)), brute.ftrl(rows, size), atol=1e-9)


def test_long_labelled_texts_are_learned(spark):
    """No labelled text is too long for the fit, and ids may be text."""
    good, bad = "a calm sentence. " * 120_000, "BUY!!! NOW!!! " * 120_000
    rows = [(f"id-{k}", x, k % 2) for k, x in enumerate([bad, good] * 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, quality int")
    got = quality.classify(docs.drop("quality"), docs.select("doc_id", "quality"))
    assert all(r["predicted"] == int(r["doc_id"][3:]) % 2 for r in got.select("doc_id", "predicted").collect())


def test_a_labelled_id_on_many_rows_counts_once_per_text(spark):
    docs = spark.createDataFrame([(1, "good words here")] * 500 + [(2, "bad")] * 2 + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, None), (None, 1), (3, 0)], "doc_id long, quality int")
    got = {(r["doc_id"], r["predicted"]) for r in quality.classify(docs, labels).collect()}
    assert got == {(1, 1), (2, 0), (3, 0)}


def test_mix_splits_ties(spark):
    """Repeated and null ids, equal texts and equal rows come as near to the targets as others."""
    wide = [(None, " ".join(f"w{k}" for k in range(10)) + f" {j}", s, 1) for s in "ab" for j in range(300)]
    equal = [(7, "one two three", s, 1) for s in "cd" for _ in range(500)]
    other = [(7, "one two three", "e", j) for j in range(500)]
    docs = spark.createDataFrame(wide + equal + other, "doc_id long, text string, source string, cut int")
    rows = mixing.mix(docs).collect()
    assert sorted(r["cut"] for r in rows) == sorted(r[3] for r in wide + equal + other)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert len(own) == len([d for d in wide + equal + other if d[2] == own[0]["source"]])
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_shared_folder_must_be_named_on_a_cluster():
    import pytest

    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_repeated_rows_spread_over_groups(spark):
    """Thousands of equal rows remove each other, and don't land in one group."""
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(None, text)] * 2000 + [(1, text + " end")], "doc_id long, text string").repartition(8)
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(docs).collect()}
    assert got == {(None, 40, 40, ""), (1, 41, 40, "end")}


def test_paths_in_canonical_form(spark):
    want = {
        "": "/", "/": "/", "/a/b": "/a/b", "/a/./b": "/a/b", "/a/../b": "/b", "/../../b": "/b", "/a/b/..": "/a/", "/a/.": "/a/", "/.": "/", "/..": "/",
        "/%61%2e%2E/x": "/a../x", "/%2e%2e/x": "/x", "/a%2fb%zz%4": "/a%2Fb%zz%4", "/%c3%a9%": "/%C3%A9%", "/a//b/../": "/a//", "/.a/..b/c.": "/.a/..b/c.", "/a%252e": "/a%252e", "/%7eu": "/~u", "/%0Ax\n": "/%0Ax\n",
    }
    rows = spark.createDataFrame([(k,) for k in want], "path string")
    assert {r["path"]: r["c"] for r in rows.select("path", urlfilter.canonical_path(F.col("path")).alias("c")).collect()} == want
    listed = spark.createDataFrame([("x.org", "/bad/", "block", "list")], "host string, path string, verdict string, kind string")
    pages = spark.createDataFrame([("http://x.org/ok/%2e%2E/b%61d/y",), ("http://x.org/bad/../ok",), ("http://x.org/bad",)], "url string")
    assert [r["verdict"] for r in urlfilter.judge(pages, listed).orderBy(F.length("url").desc()).collect()] == ["block", "allow", "allow"]


def test_listed_urls_by_their_canonical_form(spark):
    """Thousands of entries, many paths on one host; rules see the URL as it stands."""
    rng = np.random.default_rng(4)
    entries = {(f"h{k}.net", "/"): "block" for k in range(3000)}
    entries |= {("big.org", "/" + "x" * int(n) + "/"): "block" for n in range(300)}
    entries |= {("sub.big.org", "/"): "allow", ("h7.net", "/keep/"): "allow"}
    rules = {("h8.net", "/"): "allow", ("h8.net:8080", "/a"): "block"}
    rows = [(h, p, v, "list") for (h, p), v in entries.items()] + [(h, p, v, "rule") for (h, p), v in rules.items()]
    hosts = ["h7.net", "h8.net", "h9.net.", "u:p@h10.net:443", "www.h11.net:80", "xh12.net", "big.org", "a.sub.big.org", "H13.net", "none.com", "h8.net:8080", "net"]
    paths = ["", "/", "/keep/1", "/a", "?q=/", "/" + "x" * 299 + "/y", "/xx", "/xx/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [f"s://h{k}.net/{k}" for k in rng.integers(0, 6000, 300)]

    def judged(url):
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        bare = host.rsplit("@", 1)[-1]
        bare = bare.rsplit(":", 1)[0] if ":" in bare and not bare.rsplit(":", 1)[1].strip("0123456789") else bare
        bare = bare.rstrip(".")
        under = lambda h, e: h == e or h.endswith("." + e)
        fit = [(1, len(h + p), v) for (h, p), v in rules.items() if under(host, h) and path.startswith(p)]
        fit += [(0, len(h + p), v) for (h, p), v in entries.items() if under(bare, h) and (path or "/").startswith(p)]
        return max(fit)[2] if fit else "allow"

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({n: F.lit("x") for n in ("tail", "start", "kind", "winner", "judged_url", "literal")})
    listed = spark.createDataFrame(rows, "host string, path string, verdict string, kind string")
    got = {r["url"]: r["verdict"] for r in urlfilter.judge(pages, listed).collect()}
    assert got == {u: judged(u) for u in urls}


def test_url_keys_dont_fuse(spark):
    listed = spark.createDataFrame([("a.or", "g/x", "block", "list")], "host string, path string, verdict string, kind string")
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert urlfilter.judge(pages, listed).first()["verdict"] == "allow"
