"""Edge cases and brute-force comparisons of the training-data operators."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from tablemill.llm import bpe, chat, components, fingerprints, mixing, quality, sharding, simhash, token_counts, toxicity, url_filters

RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, `Quality` string"
LONG = "The quick brown fox is of the and to. " * 2000
TEXTS = ["", None, "one", "It's  we're\n\n a test! 'll", "a b c a b c a b c", "Größe 12½ 🙂 日本 語\t\tx", LONG, LONG, "same words here now", "same words here now", "<s>x</s>▁ y", " ", "\n", "  \n lead"]


def rows_of(texts):
    rows = [(k, t, ("en", "de", None, "xx")[k % 4], ("a", "b", None)[k % 3], 1, "clash", "clash") for k, t in enumerate(texts)]
    return [*rows, rows[4], (None, "no id here at all", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def test_sharding(docs, empty):
    plan = sharding.ShardPlan(tuple("abcdefg"), 101)
    got = sharding.place(docs, ["doc_id"], plan).collect()
    table = sharding.fill_table(plan.shards, plan.slots)
    assert len(got) == len(TEXTS) + 2 and all(r["shard"] == plan.shards[table[r["slot"]]] for r in got)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.fill_table(plan.shards[:-1], plan.slots)
    assert sum(a != b for a, b in zip(table, fewer, strict=True)) < 50  # most slots stay where they were
    spread = sharding.place(docs, ["source"], plan, ["doc_id"]).collect()
    assert len({r["shard"] for r in spread if r["source"] == "a"}) > 1
    assert sharding.place(empty, ["doc_id"], plan, ["text"]).count() == 0
    with pytest.raises(ValueError):
        sharding.fill_table("ab", 10)


def test_bpe_equals_the_library(spark, docs, empty):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(bpe.vocabulary(RANKS).ranks), special_tokens={})
    draw = random.Random(5)
    texts = [x or "" for x in TEXTS] + ["".join(draw.choice("'  \nslretvmdSx1!é 　") for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    texts += ["x" * 5000, "'" * 300 + "s"]
    for text, ids in zip(texts, bpe.encode_texts(texts, bpe.known_pieces(RANKS)), strict=True):
        assert ids.tolist() == own.encode_ordinary(text)
    for r in bpe.round_trip(docs, RANKS).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r["ids"] == own.encode_ordinary(r["text"] or "") and bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.decode(bpe.encode(docs, RANKS), RANKS).count() == len(TEXTS) + 2
    assert bpe.round_trip(empty, RANKS).count() == 0


def test_fingerprints(docs, empty):
    got = fingerprints.compare_with_edit(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()
    texts = {k: t or "" for k, t in enumerate(TEXTS)}
    order = sorted(texts, reverse=True)
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert len(got) == len(texts) and prints[6] == prints[7] and prints[0] == prints[1] and prints[2] != prints[3]
    for r in got:
        own, after = texts[r["doc_id"]], texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        half = len(own) // 2
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fingerprints.compare_with_edit(docs).count() == len(TEXTS) + 2
    assert fingerprints.compare_with_edit(empty).count() == 0


def plain_tree(text):
    """The tree of fingerprints.tree, by the rules as they are written."""
    escaped = (text or "").replace("\x01", "\x01\x02").replace("\0", "\x01\x03")
    cut = lambda x, ends: [y for n, y in enumerate(re.sub(f"({ends})", "\\1\0", x).split("\0")) if y or not n]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections = []
    for s in cut(escaped, "\n[ \t\r]*\n[ \t\n\x0b\f\r]*"):
        paragraphs = [[sha(x) for x in cut(p, r"[.!?:;,|]+[ \t\r]+")] for p in cut(s, "\n")]
        sections.append((sha("".join(sha("".join(p)) for p in paragraphs)), [(sha("".join(p)), p) for p in paragraphs]))
    return sections


def test_trees_equal_a_plain_version(spark):
    draw = random.Random(8)
    texts = [*TEXTS, "a\0b c", "a\x01b c", "a\x01\x03b c", "\0", "\x01", "x. \n\n \n\ny, z|  q\n", *("".join(draw.choices("ab .,\n\t|:\r", k=draw.randint(0, 80))) for _ in range(300))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r for r in df.select("k", fingerprints.tree(df.t).alias("x"), fingerprints.fingerprint(fingerprints.tree(df.t)).alias("p")).collect()}
    for k, t in enumerate(texts):
        want = plain_tree(t)
        assert [(s["hash"], [(p["hash"], p["leaves"]) for p in s["paragraphs"]]) for s in got[k]["x"]] == want
        body = ";".join(f"{h[:12]}=" + "|".join(f"{g[:12]}>" + ",".join(x[:12] for x in leaves) for g, leaves in ps) for h, ps in want)
        assert got[k]["p"] == hashlib.sha256("".join(h for h, _ in want).encode()).hexdigest() + ":" + body
    assert len({got[k]["p"][:64] for k, t in enumerate(texts)}) == len({t or "" for t in texts})


def test_edits_are_located(spark):
    long = "\n\n".join(f"Title {k}\nfirst {k}, second {k}. third\nlast {k}" for k in range(40))
    pairs = [("a. b. c.\n\nd. e.", "a. X. c.\n\nd. e."), (None, ""), (long, long.replace("second 17", "changed")), (long, long.replace("last 5", "last; 5"))]
    df = spark.createDataFrame(pairs, "l string, r string")
    trees = fingerprints.tree(df.l), fingerprints.tree(df.r)
    both = fingerprints.compare(*map(fingerprints.fingerprint, trees))
    got = df.select(fingerprints.edits(*trees).alias("e"), both.alias("c")).collect()
    assert [[tuple(x) for x in r["e"]] for r in got] == [[(0, 0, 1)], [], [(17, 1, 1)], [(5, 2, 0)]]
    assert [(r["c"]["sections"], r["c"]["paragraphs"], r["c"]["leaves"]) for r in got] == [(1, 1, 1), (0, 0, 0), (1, 1, 1), (1, 1, 1)]
    assert got[1]["c"]["likeness"] == 1 and 0.97 < got[2]["c"]["likeness"] < 1


def test_chat_formatting(spark):
    turns = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b<|x \\ </s>[INST]"), (1, 2, "user", "c"), (2, 0, "user", "a"), (2, 1, "assistant", "b<|x \\ </s>[INST]"),
        (3, 0, "user", "a"), (3, 1, "assistant", "z\\"), (3, 2, "us\ner", None), (4, 0, "user", "a"), (4, 1, "assistant", "z\\"), (4, 2, "assistant", "[/INST]"),
        (None, None, None, None), (5, 0, "user", "a"), (5, 0, "user", "a"), *[(9, k, "assistant", str(k)) for k in range(1200)],
    ]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, depth string")
    tree = chat.prefix_tree(df)
    want = defaultdict(list)
    for t in turns:
        want[t[0]].append((t[2] or "", t[3] or ""))
    got = {r["conv_id"]: r for r in chat.read_back(tree).collect()}
    assert got.keys() == want.keys()
    for key, said in want.items():
        r, loss = got[key], "".join(x for role, x in said if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(said), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    segments = sorted(tree.segments.collect(), key=lambda s: (s["tree"], s["start"]))
    assert len(segments) == len({(k, tuple(v[: n + 1])) for v in want.values() for n in range(len(v)) for k in [n]})
    for a, b in zip(segments, segments[1:], strict=False):
        assert b["start"] == (a["end"] if a["tree"] == b["tree"] else 0)
    assert all(sum(x["end"] - x["start"] for x in s["ancestors"]) == s["position"] for s in segments)
    assert chat.read_back(chat.prefix_tree(df.limit(0))).count() == 0


def test_toxicity(spark):
    draw = random.Random(2)
    plain = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    rows = [(k, " ".join(draw.choices(plain, k=40)) + (" awful awfully" if k % 4 == 0 else "")) for k in range(400)]
    df = spark.createDataFrame([*rows, (None, None), (900, ""), (901, "awfuller " + "alpha " * 20000), rows[0]], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.score(df, model).collect()}
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k, _ in rows) and got[None] == got[900] < 0.5 and got[901] > 0.5
    nothing = toxicity.fit(df.limit(0), labels.limit(0))
    assert toxicity.score(df, nothing).count() == 404 and toxicity.score(df.limit(0), model).count() == 0


def test_token_counts_equal_the_library(docs, empty):
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.count_tokens(docs, PIECES).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "no id here at all" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(own.encode(text))) and r["over_limit"] == (r["n_tokens"] > 4096)
    assert token_counts.count_tokens(empty, PIECES).count() == 0


def test_quality_measures(docs, empty):
    got = quality.judge(docs, out="q").collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        own = words(r["text"])
        windows = [tuple(own[k : k + 3]) for k in range(len(own) - 2)]
        counts = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
        lines = [x for x in (r["text"] or "").split("\n") if words(x)]
        q = r["q"]
        assert (q["n_words"], q["word_chars"], q["n_repeat_words"]) == (len(own), sum(map(len, own)), len(covered))
        assert q["n_dup_lines"] == len(lines) - len(set(lines)) and q["n_symbols"] == len(re.findall(r"[#*$%&|<>]", r["text"] or ""))
        assert q["base_failed"] == (len(own) < 50 or 100 * len(covered) > 50 * len(own)) and not (q["kept"] and q["base_failed"])
    assert quality.judge(docs).where("quality.kept").count() >= 0 and quality.judge(empty).count() == 0


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs, block=8).taken().collect()
    assert len(got) == len(TEXTS) + 2 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for own in by.values():
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], abs=1)
    again = mixing.mix(docs.repartition(7), block=8).taken().collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(empty).taken().count() == 0
    assert mixing.repeat(docs, mixing.mix(docs)).columns == docs.columns
    clashing = docs.toDF("doc_id", "text", "lang", "source", "_id", "_times", "_copy")
    repeated = mixing.repeat(clashing, mixing.mix(clashing))
    assert repeated.columns == clashing.columns and repeated.count() == mixing.repeat(docs, mixing.mix(docs)).count()


def brute_components(prints):
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    listed = sorted(prints)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                parent[root(b)] = root(a)
    return {f: root(f) for f in listed}


@pytest.mark.parametrize("paired", [256, 1])
def test_simhash_links_all_within_two_bits(spark, paired):
    draw = random.Random(3)
    bases = [draw.getrandbits(63) for _ in range(8)]
    prints = {b ^ sum(1 << k for k in draw.sample(range(64), n)) for b in bases for n in (0, 1, 2, 2, 3, 4)}
    prints = {p - ((p >> 63) << 64) for p in prints}
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), paired)
    got = {r["node"]: r["component"] for r in components.connected_components(edges, "a", "b").collect()}
    want = brute_components(prints)
    groups = lambda m: {frozenset(x for x in prints if m.get(x, x) == v) for v in {m.get(x, x) for x in prints}}
    assert groups(got) == groups(want)


def test_near_duplicates(docs, empty):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert got[6]["component_id"] == got[7]["component_id"] == 6 and got[9]["component_id"] == 8
    assert got[0]["fingerprint"] == "0" * 16 and got[11]["component_id"] == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({r["component_id"] for r in got.values()})
    assert simhash.keep_one(empty).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1200)] + [(None, 3), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges, "a", "b").collect()}
    assert {got[k] for k in range(301)} == {0} and {got[k] for k in range(1000, 1200)} == {1000}


def test_url_filters(spark):
    urls = [
        "http://EXAMPLE.org/en/1?x", "https://a.b.org/q", "http://x.com/de/9#t", "http://x.com/fr/", "notaurl", None, "http://other.net/p/", "https://www.other.net/p?utm_source=f",
        "https://far.net/1", "https://far.net/2", "http://notorg/", "http://h.com", "http://x.com/de/9#t",
    ]
    html = {"https://far.net/1": '<link rel="canonical" href="http://x.com/de/9#t">', "https://far.net/2": '<meta http-equiv="refresh" content="0; url=https://far.net/1">'}
    df = spark.createDataFrame([(k, u, html.get(u), "clash") for k, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    rules = [url_filters.parse_rule(x) for x in ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")]
    got = {r["page_id"]: r for r in url_filters.filter_urls(df, rules).collect()}
    assert [got[k]["verdict"] for k in range(13)] == ["block", "allow", "block", "allow", "allow", "allow", "allow", "allow", "block", "block", "allow", "allow", "block"]
    assert (got[0]["host"], got[0]["path"], got[0]["rule"]) == ("example.org", "/en/1", "example.org/en/1") and got[5]["host"] == ""
    assert url_filters.filter_urls(df.limit(0), rules).count() == 0 and url_filters.filter_urls(df, []).count() == 13


def test_stated_links(spark):
    page = "http://x.com/a/b.html?q=1#t"
    told = {
        "http://y.org/1?a=1&amp;b=2": "http://y.org/1?a=1&b=2", "//x.com/de/9": "http://x.com/de/9", "/de/9?z": "http://x.com/de/9?z", "c.html": "http://x.com/a/c.html",
        "../de/./9": "http://x.com/de/9", "?p=2": "http://x.com/a/b.html?p=2", "../../../up/": "http://x.com/up/", "#here": None, "mailto:a@b": None, "d/..": "http://x.com/a/",
    }
    rows = [(page, f'<link rel="canonical" href="{link}">') for link in told] + [("x", '<link rel=canonical href="/z">'), (None, '<link rel=canonical href="/z">'), (page, None)]
    rows.append((page, '<!-- <link rel="canonical" href="/hidden"> --><META http-equiv=Refresh content="0; URL=/seen"><!-- open <link rel=canonical href=/no>'))
    df = spark.createDataFrame(rows, "url string, html string")
    got = {tuple(r) for r in url_filters.page_links(df).collect()}
    assert got == {(page, "https://x.com/a/b.html?q=1"), (page, "http://x.com/seen")} | {(page, t) for t in told.values() if t}
    blocked = [("http://x.com/de/9", None), ("http://a.net/1", '<link rel="canonical" href="//x.com/de/9">'), ("http://a.net/2", '<!--<link rel="canonical" href="//x.com/de/9">-->')]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(blocked)], "page_id int, url string, html string")
    verdicts = {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(df, [url_filters.parse_rule("block com/de/")]).collect()}
    assert verdicts == {0: "block", 1: "block", 2: "allow"}


def test_fingerprints_bit_by_bit(docs):
    import xxhash

    for r in simhash.near_duplicates(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        own = [w.translate({k: k + 32 for k in range(65, 91)}) for w in words(r["text"])]
        shingles = [" ".join(own[k : k + 3]) for k in range(max(1, len(own) - 2))] if own else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert r["fingerprint"] == f"{want:016x}"
