import datetime
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ringspan.llm import chat, jaccard_join, url_filters, warc
from ringspan.llm.common import fresh
from ringspan.operators.components import components

from .test_fixtures import DOCS, documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def classes(rows, threshold=0.8):
    """(doc_id, class_id, n_links) of every row by brute force."""
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall(text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up, links = list(range(len(rows))), Counter()

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if sets[i] and sets[j] and shared * 10 >= 8 * (len(sets[i]) + len(sets[j]) - shared):
            links[i] += 1
            links[j] += 1
            up[root(j)] = root(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    least = {g: min([x for x in ids if x is not None], default=None) for g, ids in groups.items()}
    return Counter((rows[i][0], least[root(i)], links[i]) for i in range(len(rows)))


def near_rows():
    rng, rows = random.Random(5), list(documents())
    for g in range(12):
        words = [f"g{g}w{rng.randrange(400)}" for _ in range(120)]
        for k in range(rng.randrange(1, 9)):
            w = list(words)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10_000)}"
            rows.append((1000 + 20 * g + k, " ".join(w), "en", "s"))
    return rows


def test_join_matches_brute_force(spark):
    rows = near_rows()
    assert Counter(map(tuple, jaccard_join.join(frame(spark, rows)).collect())) == classes(rows)


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 3)
    rows = near_rows()
    assert Counter(map(tuple, jaccard_join.join(frame(spark, rows)).collect())) == classes(rows)


def test_shuffled_sides_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_SIDE", -1)
    rows = near_rows()
    assert Counter(map(tuple, jaccard_join.join(frame(spark, rows)).collect())) == classes(rows)


def test_keep_one_of_each_class(spark):
    rows = near_rows()
    kept = jaccard_join.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark).columns
    ids = Counter(r.doc_id for r in kept.collect())
    wordless = Counter(r[0] for r in rows if not WORD.search(r[1] or ""))
    want = Counter({c for (_, c, _), _ in classes([r for r in rows if WORD.search(r[1] or "")]).items()}) + wordless
    # two texts share id 12; both stay, each being a class of its own
    want[12] = 2
    assert ids == want


def test_depths_reach_the_recall():
    least, middle, full, most = jaccard_join.depths()
    assert (least, middle, full) == (4, 5, 6)
    reached = lambda hot, d: 1 - (1 - 0.8**least) ** (jaccard_join.TREES - hot) * (1 - 0.8**d) ** hot
    assert reached(most, full) >= jaccard_join.TARGET_RECALL > reached(most + 1, full)
    assert reached(jaccard_join.TREES, middle) >= jaccard_join.TARGET_RECALL
    assert jaccard_join.match_depth(0.95) == 6
    with pytest.raises(ValueError):
        jaccard_join.match_depth(0.2)


def test_hot_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_CELL", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 4)
    rows = near_rows() + [(5000 + k, " ".join([f"c{i}" for i in range(200) if i != 7 * k]), "en", "s") for k in range(12)]
    assert Counter(map(tuple, jaccard_join.join(frame(spark, rows)).collect())) == classes(rows)


def test_members_of_many_hot_cells_are_matched_shorter(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_CELL", 2)
    nodes = lambda rows: jaccard_join.nodes_of(frame(spark, rows)).filter("node IS NOT NULL").mapInArrow(jaccard_join._signatures, "doc_id bigint, node binary, signature binary").select("node", "signature")
    alike = [(k, " ".join(f"c{i}" for i in range(300) if i != 9 * k), "en", "s") for k in range(8)]
    cuts = [r.cuts for r in jaccard_join.met_in(nodes(alike), 0.8, 0.9999).dropDuplicates(["node"]).collect()]
    miss = lambda c: np.prod([1 - 0.8**d for d in c])
    assert len(cuts) == 8 and {d for c in cuts for d in c} >= {4, 5} and all(1 - miss(c) >= 0.9999 for c in cuts)


def test_chained_texts_stay_linear(spark):
    """Each text is loosely like its neighbours (0.67), so all are one component of likely pairs."""
    sizes = {}
    for n in (1500, 3000):
        rows = [(k, " ".join(f"w{i}" for i in range(20 * k, 20 * k + 104)), "en", "s") for k in range(n)]
        nodes = jaccard_join.nodes_of(frame(spark, rows)).mapInArrow(jaccard_join._signatures, "doc_id bigint, node binary, signature binary").select("node", "signature")
        sizes[n] = jaccard_join.likely(nodes)[0].count()
    assert 0 < sizes[1500] < 20 * 1500 and sizes[3000] < 2.2 * sizes[1500]
    assert {(r.n_links, r.doc_id == r.class_id) for r in jaccard_join.join(frame(spark, rows[:400])).collect()} == {(0, True)}


def test_postings():
    held = jaccard_join.Postings([np.array([2, 3, 4], np.uint64), np.array([1], np.uint64)])
    assert list(held.shared(np.array([1, 2, 3], np.uint64))) == [2, 1] and list(held.shared(np.array([9], np.uint64))) == [0, 0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}


PAGES = [
    (1, "http://www.Example.com/a?x=1#f", "<p>one</p>"), (2, "https://example.com/b", "<p>two</p>"), (3, "http://sub.example.org:8080/", "<p>one</p>"), (5, None, None), (4, "not a url", ""), (None, "http://example.com/z", "<p>one</p>"),
    (6, "http://é.example.com/ü\r\nX: y", "<p>é</p>\r\n\r\nWARC/1.1"), (7, "http://example.com/big", "x" * 300_000), (2, "https://example.com/b", "<p>two</p>"), (8, "http://user@example.com:80/p", "<p>two</p>"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, html string, digest string, refers_to int")


def test_archives_and_index(spark):
    folder = fresh(spark, "w")
    directory = warc.write_index(warc.write_archives(pages(spark), folder), f"{folder}-i")
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.read_index(directory)).collect())
    want = Counter({(1, 10, "response", None): 1, (2, 10, "response", None): 2, (3, 10, "revisit", 1): 1, (4, 0, "response", None): 1, (5, 0, "revisit", 4): 1, (None, 10, "revisit", 1): 1, (6, len("<p>é</p>\r\n\r\nWARC/1.1".encode()), "response", None): 1, (7, 300_000, "response", None): 1, (8, 10, "revisit", 2): 1})
    assert got == want
    index = warc.CaptureIndex(directory.collect())
    (fields, block), = index.read("http://example.com/a?x=1")
    assert fields["warc-type"] == "response" and block.endswith(b"<p>one</p>")
    assert index.find("http://example.com/none") == [] and len(index.find("http://example.com/b")) == 2


def test_small_payloads_may_all_be_responses(spark):
    folder = fresh(spark, "w")
    captures = warc.write_archives(pages(spark), folder, min_bytes=1000)
    assert {r.record_type for r in warc.read_archives(captures).collect()} == {"response"}


def test_url_keys():
    assert warc.url_key("http://www.Example.com/a?x=1#f") == "com,example)/a?x=1"
    assert warc.url_key("https://b.a.org:8443") == "org,a,b:8443)/"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad/") == "http://[bad/"


def test_many_files_and_blocks(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example.com/{i}", f"<p>{i % 50}</p>") for i in range(300)]
    folder = fresh(spark, "w")
    directory = warc.write_index(warc.write_archives(pages(spark, rows), folder), f"{folder}-i")
    read = warc.read_archives(warc.read_index(directory)).collect()
    assert len(read) == 300 and sum(r.record_type == "response" for r in read) == 50


DAY = datetime.date(2024, 1, 1)


def day(n):
    return DAY + datetime.timedelta(days=n)


def test_intervals(spark):
    rows = [("block", "a.com", "add", day(1)), ("block", "a.com", "add", day(2)), ("block", "a.com", "remove", day(5)), ("block", "a.com", "remove", day(6)), ("block", "a.com", "add", day(9)), ("block", "a.com", "remove", day(9)), ("allow", "b.com", "remove", day(1)), ("block", None, "add", day(1)), ("block", "c.com", "add", None)]
    got = {tuple(r) for r in url_filters.intervals(spark.createDataFrame(rows, "list string, key string, action string, at date")).collect()}
    assert got == {("block", "a.com", day(1), day(5)), ("block", "a.com", day(9), None)}


@pytest.mark.parametrize("small", [100, -1])
def test_filters_match_brute_force(spark, small):
    rng = random.Random(2)
    keys = ["example.com", "a.example.com", "b.a.example.com", "a.example.com/x", "other.net"]
    entries = [(rng.choice(["block", "allow"]), rng.choice(keys), rng.choice(["add", "remove"]), day(rng.randrange(200))) for _ in range(60)]
    listed = url_filters.intervals(spark.createDataFrame(entries, "list string, key string, action string, at date"))
    held = [tuple(r) for r in listed.collect()]
    urls = ["http://b.a.example.com/x/y", "https://A.example.com/", "http://example.com", "http://other.net./q", "http://solo/x", None, "nonsense"]
    captures = [(i, rng.choice(urls), None if i == 7 else day(rng.randrange(220))) for i in range(80)] + [(0, urls[0], day(3))] * 2
    got = Counter((r.page_id, r.fetched, r.verdict, r.n_active) for r in url_filters.evaluate(spark.createDataFrame([(*c, "x") for c in captures], "page_id bigint, url string, fetched date, key string"), listed, small).collect())
    want = Counter()
    for page, url, when in captures:
        m = re.match(r"[a-z]+://([^/]+)(?:/([^/]+))?", (url or "").lower())
        host = m[1].rstrip(".") if m else ""
        labels = host.split(".") if host else []
        own = {".".join(labels[-k:]): k for k in range(2, len(labels) + 1)} | ({host: 1} if len(labels) == 1 else {}) | ({f"{host}/{m[2]}": 100} if m and m[2] else {})
        active = [(own[k], lst == "allow", k, lst) for lst, k, a, b in held if when and k in own and a <= when and (b is None or when < b)]
        want[page, when, max(active)[3] if active else "none", len(active)] += 1
    assert got == want


@pytest.mark.parametrize("small", [1000, -1])
def test_open_entries_never_end_and_addresses_have_no_parents(spark, small):
    entries = [("block", "a.com", "add", day(0)), ("block", "3.4", "add", day(0)), ("block", "1.2.3.4", "add", day(0)), ("block", "[::1]", "add", day(0))]
    listed = url_filters.intervals(spark.createDataFrame(entries, "list string, key string, action string, at date"))
    at = [("http://a.com/", datetime.date(1970, 1, 1), "none"), ("http://a.com/", datetime.date(2099, 12, 31), "block"), ("http://a.com/", datetime.date(2100, 1, 1), "block"), ("http://a.com/", datetime.date(2500, 1, 1), "block"), ("http://9.2.3.4:80/", day(1), "none"), ("http://1.2.3.4/x", day(1), "block"), ("http://u@[::1]:8080/x", day(1), "block")]
    found = url_filters.evaluate(spark.createDataFrame([(i, u, d) for i, (u, d, _) in enumerate(at)], "page_id bigint, url string, fetched date"), listed, small)
    assert {r.page_id: r.verdict for r in found.collect()} == {i: v for i, (_, _, v) in enumerate(at)}


#: Costs and legal successions, written out from the docstring: "" is the start of a conversation.
CHANGE = {
    ("system", "system"): 0, ("system", "user"): 2, ("system", "assistant"): 3, ("user", "system"): 3, ("user", "user"): 0, ("user", "assistant"): 3,
    ("assistant", "system"): 3, ("assistant", "user"): 3, ("assistant", "assistant"): 0, ("other", "system"): 1, ("other", "user"): 1, ("other", "assistant"): 1,
}
AFTER = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def with_empty_turns(best):
    """Least costs by last role when any number of empty turns, at 2 each, may follow."""
    for _ in range(4):
        for last in list(best):
            for new in AFTER[last]:
                best[new] = min(best.get(new, 10**9), best[last] + 2)
    return best


def cheapest(roles):
    best = {"": 0}
    for role in roles:
        now = {last: c + 1 + CHANGE[role, last] for last, c in best.items() if last}
        for last, c in with_empty_turns(dict(best)).items():
            for new in AFTER[last]:
                now[new] = min(now.get(new, 10**9), c + CHANGE[role, new])
        best = now
    return min(c for last, c in with_empty_turns(dict(best)).items() if last in ("", "assistant") and (last or not roles))


def cost(roles, turns):
    """Of (new role, action, roles inserted before) of each turn, with the empty turns that close the conversation."""
    total, last = 0, ""
    for role, (new, action, added) in zip(roles, turns, strict=True):
        merged = "merge" in action
        assert ("relabel" in action) == (role != new) and not (merged and (added or new != last))
        for r in (*added, *(() if merged else (new,))):
            assert r in AFTER[last]
            last = r
        total += CHANGE[role, new] + merged + 2 * len(added)
    return total + 2 * {"": 0, "assistant": 0, "user": 1, "system": 2}[last]


def test_costs_by_hand():
    assert [cheapest(r) for r in ([], ["user"], ["user", "assistant"], ["assistant"], ["user", "user"], ["system"], ["other"], ["user", "system"])] == [0, 2, 0, 2, 3, 4, 3, 3]


def test_repair_is_cheapest_and_splits():
    for n in range(1, 5):
        for roles in itertools.product(("system", "user", "assistant", "other"), repeat=n):
            whole = chat.repair(list(roles))
            assert cost(roles, whole) == cheapest(roles)
            for k in range(1, n):
                ends = chat.bounds([chat.summary(list(roles[:k])), chat.summary(list(roles[k:]))])
                parts = chat.repair(list(roles[:k]), 0, ends[1]) + chat.repair(list(roles[k:]), ends[1])
                assert cost(roles, parts) == cheapest(roles)


def legal(text):
    roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return len(roles) % 2 == 0 and roles[::2] == ["user"] * (len(roles) // 2) and roles[1::2] == ["assistant"] * (len(roles) // 2) and text.count("<|im_end|>\n") == text.count("<|im_start|>")


def rendered(found):
    out = defaultdict(str)
    for r in sorted(found, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.part, r.chunk, r.pos)):
        out[r.conv_id] += r.rendered
    return out


@pytest.mark.parametrize("chunk", [2048, 3])
def test_conversations(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "Human", "bot", "tool", " "]), rng.choice(["hi", None, "", "<|im_start|>user\nx", "é" * 500])) for c in range(25) for t in range(rng.randrange(1, 12))]
    rows += [(None, 1, "user", "a"), (None, None, "user", "b"), (3, 1, "user", "tie"), (3, 1, "user", "tie")] + [(77, t, ["user", "assistant"][t % 2 if t % 7 else 0], str(t)) for t in range(200)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, action string, part int")
    found = chat.format_chats(df).collect()
    assert len(found) == len(rows) and all(map(legal, rendered(found).values()))
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.part, r.chunk, r.pos)):
        by[r.conv_id].append(r)
    for turns in by.values():
        roles = [chat.role_of(r.role) for r in turns]
        assert cost(roles, [(r.new_role, r.action, r.inserted.split(",") if r.inserted else []) for r in turns]) == cheapest(roles)


def test_a_very_long_conversation(spark):
    rng = random.Random(8)
    rows = [(5, t, rng.choice(["user", "assistant", "assistant", "tool", None, "system"]), str(t)) for t in range(7000)]
    found = sorted(chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect(), key=lambda r: r.turn)
    roles = [chat.role_of(r[2]) for r in rows]
    assert len({(r.part, r.chunk) for r in found}) > 2 and [r.turn for r in found] == list(range(7000))
    assert cost(roles, [(r.new_role, r.action, r.inserted.split(",") if r.inserted else []) for r in found]) == cheapest(roles)
    assert all(map(legal, rendered(found).values()))


def test_clean_conversations_stay(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    found = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert {r.action for r in found} == {"keep"}
    assert rendered(found)[1] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"


def test_empty_tables(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
    assert jaccard_join.join(spark.createDataFrame([], DOCS)).count() == 0 and jaccard_join.keep_one(spark.createDataFrame([], DOCS)).count() == 0
    folder, none = fresh(spark, "w"), pages(spark, [])
    assert warc.read_archives(warc.read_index(warc.write_index(warc.write_archives(none, folder), f"{folder}-i"))).count() == 0
    captures, entries = spark.createDataFrame([], "page_id bigint, url string, fetched date"), spark.createDataFrame([], "list string, key string, action string, at date")
    assert url_filters.evaluate(captures, url_filters.intervals(entries)).count() == 0
    one = spark.createDataFrame([(1, "http://a.com", DAY)], "page_id bigint, url string, fetched date")
    assert url_filters.evaluate(one, url_filters.intervals(entries)).first().verdict == "none"


def test_every_page_is_looked_up_in_the_two_level_index(spark, monkeypatch):
    """Null and repeated ids, one URL on more pages than a block has lines, and keys that prefix others: each capture once."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)  # blocks are written in tasks, which get the value with the closure or keep 3,000
    urls = [None, "", "http://a.b/", "http://a.b/x", "http://a.b/xy", "https://www.a.b/x"] + ["http://hot.example/p"] * 40
    rows = [(i // 2 if i % 9 else None, urls[i % len(urls)], f"<p>{i % 11}</p>") for i in range(400)] + [(5, "http://a.b/x", "<p>same</p>")] * 3
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    folder = f"{warc.fresh(spark, 'warc')}"
    captures = warc.write_archives(pages, folder)
    directory = warc.write_index(captures, f"{folder}-index")
    found = [tuple(r) for r in warc.look_up(pages, directory).collect()]
    assert Counter(found) == Counter(tuple(r) for r in captures.collect()) and len(found) == len(rows)
    some = spark.createDataFrame([(5, "http://a.b/x", None), (10**9, "http://nowhere.example/", None)], pages.schema)
    assert len(warc.look_up(some, directory).collect()) == sum(r[0] == 5 and warc.url_key(r[1]) == warc.url_key("http://a.b/x") for r in rows)


def test_small_blocks_are_searched(spark):
    """A binary search in blocks of three lines, key by key, nulls first."""
    index = warc.CaptureIndex([])
    lines = sorted(([k, p, "f", 0, 0] for k in ("", "a", "ab", "b") for p in (None, 1, 1, 2, 30)), key=lambda x: warc._place(*x[:2]))
    blocks = [lines[i : i + 3] for i in range(0, len(lines), 3)]
    index.blocks, index.firsts = blocks, [warc._place(*b[0][:2]) for b in blocks]
    index._lines = lambda i: ([warc._place(*x[:2]) for x in blocks[i]], blocks[i])
    for k in ("", "a", "aa", "ab", "b", "c"):
        for p in (None, 0, 1, 2, 30):
            assert list(index.captures(k, p)) == [x for x in lines if x[:2] == [k, p]]


def test_the_query_finds_its_records_by_lookups(spark, monkeypatch):
    called = []
    monkeypatch.setattr(warc, "look_up", lambda *a, f=warc.look_up: called.append(1) or f(*a))
    monkeypatch.setattr(warc, "read_index", None)
    assert warc.op7_warc(spark, "/root/testdata/sf0.001").count() == 50 and called
