"""Conversation repair, spelling variants and the URL filter against brute force and on odd input."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import conversations, spelling, url_filter
from factloom.llm.conversations import op11_conversations, repair
from factloom.llm.spelling import counted_words, neighbours, op12_spelling, variants
from factloom.llm.url_filter import RULES, Filter, cascade, fit, judge, op13_url_filter

TALK = "conv_id long, turn long, role string, text string"


# conversations


def cheapest(roles, faults, insert=5):
    """(cost, audit) by memoised search over (row, role before), with what follows compared as text."""

    @functools.cache
    def best(at, last, added=0):
        """From row `at` on, behind a row whose role starts with `last`; two rows at most come in at one place."""
        found = [(0, "")] if at == len(roles) and last in ("", "a") else []

        def take(cost, letter, to, new, added=0):
            more, audit = best(to, new, added)
            found.append((cost + more, letter + audit))

        new = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        if at < len(roles):
            stays = {"": 0, "truncated": 5}.get(faults[at])
            take(2, "D", at + 1, last)
            if stays is not None and roles[at] and roles[at] in new:
                take(stays, "K", at + 1, roles[at])
            if stays is not None:
                take(stays + 1, "R", at + 1, new[-1])
        if added < 2:
            take(insert, "I", at, new[-1], added + 1)
        return min(found, default=(10**9, ""))

    return best(0, "")


def slow_repair(rows):
    """All results, row by row."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        word = lambda v: " " if v is None else str(v)
        what = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        groups[conv]
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        groups[conv] += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            black = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not black else "duplicate" if (role, text) in seen else "truncated" if black[-1] not in ".!?" else "")
            seen.add((role, text))

        cost, audit = cheapest([r[1][:1] for r in own], faults)
        lines, rest, said = [], iter(own), ""
        for letter in audit:
            row = next(rest) if letter != "I" else (None, "", "")
            if letter == "D":
                continue
            expected = "assistant" if said.endswith("u") else "user"
            role = row[1] if letter == "K" else expected
            lines.append(f"{role}:{row[2]}")
            said += role[:1]
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        count = Counter(faults)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha)
    return out


def found(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "s", "under"]
    texts = ["Yes.", "No!", "cut off", "why?  \n", " \t", "", None, "Größe.", "x" * 50 + "."]
    rows = []
    for conv in range(90):
        turns = list(range(rng.randint(1, 9)))
        rows += [(conv, t + (t > 4) * conv % 3, rng.choice(["user", "assistant"][t % 2 :] + roles[:3]) if conv % 3 else rng.choice(roles), f"{rng.choice(texts)}" if conv % 2 else rng.choice(texts)) for t in turns]
    rows += [(None, t, "user", f"t{t}.") for t in range(3)] + [(200, None, "assistant", "a."), (200, None, "user", "b."), (200, 7, None, None)]
    rows += [(201, 5, "user", "same.")] * 4 + [(202, t, "user" if t % 2 else "assistant", f"{t} word{'.' * (t % 3)}") for t in range(60)]
    return [*rows, rows[0], rows[20]]


def test_repairs_match_a_search(spark, talk):
    df = spark.createDataFrame(talk, TALK).repartition(5)
    want = slow_repair(talk)
    assert found(repair(df)) == want
    assert {e for r in want.values() for e in r[6]} == set("DKR")  # at these costs nothing is worth putting in


@pytest.mark.parametrize("insert", [1, 2])
def test_rows_are_put_in_where_that_is_cheap(monkeypatch, insert):
    monkeypatch.setattr(conversations, "INSERT", insert)
    rng = random.Random(insert)
    talks = [[(rng.randrange(4), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 7))] for _ in range(200)]
    cost, audit = conversations.solve([np.array([4 * r + f for r, f in t], dtype=np.int64) for t in talks])
    want = [cheapest(["sua?"[r] for r, _ in t], [("", "blank", "duplicate", "truncated")[f] for _, f in t], insert) for t in talks]
    assert list(zip(cost.tolist(), audit, strict=True)) == want
    assert any("I" in a for a in audit)


def test_long_conversations_match_short_ones(spark, talk):
    df = spark.createDataFrame([r for r in talk if r[0] != 200 and r[0] != 0], TALK).repartition(3)  # rows of one turn go by another order there
    want = found(repair(df))
    for segment in (0, 2, 16):
        assert found(repair(df, rows=0, segment=segment)) == want
    assert found(repair(df, rows=30)) == want


def test_one_conversation_of_many_rows(spark):
    rows = [(1, t // 2, "user" if t % 3 else "assistant", "copy." if t % 7 == 0 else f"text {t}") for t in range(3_000)] + [(2, 1, "user", "a.")]
    df = spark.createDataFrame(rows, TALK)
    few = found(repair(df, rows=100, segment=7))
    assert few.keys() == {1, 2} and few[1][6].count("D") > 400 and few[1][1:4] == found(repair(df))[1][1:4]
    assert few[1][0] == found(repair(df))[1][0]


def test_conversations_of_odd_tables(spark):
    empty = spark.createDataFrame([], TALK)
    assert found(repair(empty)) == {}
    dropped = next(i for i in range(1_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    named = spark.createDataFrame([(dropped, 0, "user", "x.", 1, "k")], TALK + ", alive int, key string")
    assert found(repair(named)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(repair(named, rows=0)) == found(repair(named))


def test_whole_conversations_table(spark, tmp_path, talk):
    spark.createDataFrame(talk, TALK).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(op11_conversations(spark, str(tmp_path))) == slow_repair(talk)


# words


def slow_words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: f for w, f in form.items() if words[f] >= 10 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def listed(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefghéö", k=rng.randint(7, 11))) for _ in range(40)]
    texts = []
    for i in range(300):
        words = rng.choices(base, weights=[40 // (k + 1) + 1 for k in range(40)], k=20)
        for k in range(3):
            w, at = words[k], rng.randrange(7)
            words[k] = rng.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "É" + w[at + 1 :], w[:at] + w[at] + w[at:]])
        texts.append((i, " ".join(words).title() + "×÷1aaaaaaaa-aaaaaaab"))
    return [*texts, texts[0], (None, "aaaaaaaa aaaaaaaaa"), (7, None), (8, ""), (9, "y" * 5_000 + " " + "y" * 5_001), (10, "y" * 5_000 + " " + "y" * 5_001)]


def test_variants_match_pairs(spark, spelled):
    words = slow_words(spelled)
    want = slow_variants(words)
    df = spark.createDataFrame(spelled, "doc_id long, text string").repartition(4)
    assert {r["word"]: r["n"] for r in counted_words(df).collect()} == words
    assert listed(variants(counted_words(df))) == want
    assert sum(r[0] is not None for r in want.values()) > 50


def test_chains_and_ties(spark):
    words = {"chained": 1_000, "chainex": 100, "chainxx": 10, "chaixxx": 1, "tiedabc": 20, "tiedabd": 20, "tiedabe": 2, "loneword": 5, "ninefold": 18, "ninefole": 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = listed(variants(df))
    assert got == slow_variants(words)
    assert got["chaixxx"][:2] == ("chainxx", "chained")
    assert got["tiedabe"][0] == "tiedabc" and got["ninefole"][0] is None


def test_neighbourhoods_are_whole_and_distinct():
    for word in ("aab", "abc", "aaaa", "é", "abcabca"):
        alphabet = "abcé"
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
        want = (want | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}) - {word}
        got = [v for _, v in neighbours([word], alphabet)]
        assert len(got) == len(set(got)) and set(got) == want


def test_hashes_of_neighbours_are_those_of_their_words(monkeypatch):
    monkeypatch.setattr(spelling, "CELLS", 7)
    words = ["abcabca", "bbbbbbb", "cabaabc"]
    for kind, first, hashes, distinct in spelling.neighbourhood(spelling._points(words), np.array([ord(c) for c in "abc"])):
        for w, i, c in np.argwhere(distinct):
            word, at = words[w], i + first
            made = word[:at] + ("" if kind == "delete" else "abc"[c]) + word[at + (kind != "insert") :]
            assert hashes[w, i, c] == spelling.word_hashes([made])[0]


def test_words_of_odd_tables(spark, docs, rows, sf):
    assert listed(op12_spelling(spark, sf)) == slow_variants(slow_words(rows))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert listed(variants(counted_words(empty))) == {}
    more = spark.createDataFrame([(1, "Wordwords wordwords", "w", 3)], "doc_id long, text string, word string, n int")
    assert listed(variants(counted_words(more))) == slow_variants(slow_words([(1, "Wordwords wordwords")]))


# pages


def slow_judge(rows, listed_keys, rules=RULES):
    out = []
    for page_id, url, *_ in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(d + s), len(d), d + s, v) for v, d, s in rules if (host == d or host.endswith("." + d)) and path.startswith(s)]
        labels = host.split(".")
        keys = {host, host + path.rstrip("/")} | {".".join(labels[i:]) for i in range(len(labels))} if host else set()
        hit = bool({k for k in keys if k} & listed_keys)
        out.append((page_id, host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "block" if hit else "allow"))
    return sorted(out, key=repr)


def judged(df):
    return sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(4)
    hosts = [f"{rng.choice(['', 'www.', 'a.b.'])}h{i}.{rng.choice(['net', 'com', 'org', 'example.org', 'dev'])}" for i in range(400)] + ["com", "ORG", "example.org", "notorg", "xexample.org"]
    paths = ["", "/", "/fr/", "/de/x", "/es/", "/en/12", "/a/b//", "?q=://x", "#/fr/", "/en/1?x"]
    rows = [(i, f"http{'s' * (i % 2)}://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    odd = [None, "", "no scheme", "x://", "://", "http:///path", "http://h5.net", "http://" + "a." * 400 + "h6.net/x", "http://é.Éx.dev/ü", "http://h7.dev//", "a://b://c"]
    return rows + [(10_000 + i, u) for i, u in enumerate(odd)] + [rows[3], (None, "http://h8.dev/q")]


def test_verdicts_match_sets(spark, urls):
    rng = random.Random(6)
    every = sorted({r[1] for r in slow_judge(urls, set())})
    keys = set(rng.sample(every, 60)) | {"dev", "h9.net/a/b", "h7.dev", "h8.dev/q", "unknown.example"} - {"", "com", "org"}
    df = spark.createDataFrame(urls, "page_id long, url string").repartition(4)
    list_ = spark.createDataFrame([(k,) for k in [*keys, None, "dev"]], "key string")
    want = slow_judge(urls, keys)
    assert judged(judge(df, list_)) == want
    assert judged(judge(df, list_, shard_keys=100, limit=200)) == want  # many shards, many passes
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"} and {r[3] for r in want} == {None, *(d + s for _, d, s in RULES)}


def test_a_list_of_nothing_and_empty_tables(spark, urls):
    df = spark.createDataFrame(urls, "page_id long, url string")
    nothing = spark.createDataFrame([], "key string")
    assert judged(judge(df, nothing)) == slow_judge(urls, set())
    assert judged(judge(df.limit(0), spark.createDataFrame([("a.com",)], "key string"))) == []
    named = spark.createDataFrame([(1, "http://a.net/x", "h", True)], "page_id long, url string, host string, listed boolean")
    assert judged(judge(named, spark.createDataFrame([("a.net",)], "key string"))) == [(1, "a.net", "/x", None, "block")]


def test_cascades_make_no_mistake():
    rng = np.random.default_rng(2)
    for n_listed, n_others in ((1, 0), (1, 1), (500, 50_000), (20_000, 20_000), (5_000, 10), (0, 100)):
        h = rng.integers(0, 2**64, (n_listed + n_others, 2), dtype=np.uint64)
        levels = cascade(h[:n_listed], h[n_listed:])
        known = Filter(1, [(0, i, size, probes, bits.tobytes()) for i, (size, probes, bits) in enumerate(levels)])
        assert (known.lists(h) == (np.arange(len(h)) < n_listed)).all()
    assert len(levels) == 0 and len(cascade(h[:30], h[30:])) > 1


def test_clashing_hashes_take_another_seed(spark, monkeypatch):
    universe = spark.createDataFrame([(f"k{i}",) for i in range(50)], "key string")
    real = url_filter._hashes
    monkeypatch.setattr(url_filter, "_hashes", lambda key, seed: real(key, seed) if seed else [c % 5 if i < 2 else c for i, c in enumerate(real(key, seed))])
    assert fit(universe, universe.limit(3))[2] == 1


def test_whole_pages_table(spark, sf, tmp_path):
    rows = [(1, "http://x.spam-farm.net/a"), (2, "http://ads.org/x"), (3, "http://good.net/spam"), (4, None), (5, "http://free-bets.dev"), (6, "http://example.org/en/19")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert judged(op13_url_filter(spark, str(tmp_path))) == slow_judge(rows, {"x.spam-farm.net", "ads.org", "free-bets.dev"})
    assert op13_url_filter(spark, sf).count() == 3
