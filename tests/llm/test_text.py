import hashlib
import random
import string
import struct
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ringspan.llm import bpe, grammar, secrets, sstable
from ringspan.llm.common import fresh
from ringspan.llm.pretokens import pieces, splitter

from .test_fixtures import DOCS, documents, frame, prose

TEXTS = st.one_of(st.text(), st.text(alphabet="aA'sStrevmld 0123\n\t.,éİŉſŒμ²\xa0 ͅéΣσςK<|>"), st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", " ", "a", "'s", "it's", "  ", "\n", "x1", "…", "İ", "ﬁ", "ά"])).map("".join))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_split_and_encode_as_the_library(name):
    path = bpe.vocabulary(name)
    split, library = splitter(path), Tokenizer.from_file(path)

    @settings(max_examples=300, deadline=None)
    @given(TEXTS)
    def same(text):
        ids = [i for w in split.words(text) for i in split.encode(w)]
        assert ids == library.encode(text, add_special_tokens=False).ids
        if not split.lower:
            assert b"".join(pieces(path)[i] for i in ids).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)

    same()


def test_round_trip(spark):
    library = Tokenizer.from_file(bpe.vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text, *_ in documents():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(frame(spark)).collect())) == want


def test_decoding_and_distinct_words(spark, monkeypatch):
    path = bpe.vocabulary("byte_bpe_50k.json")
    coded = bpe.encode(frame(spark), path)
    assert Counter((r.doc_id, r.decoded) for r in bpe.decode(coded, path).collect()) == Counter((r[0], r[1] or "") for r in documents())
    split, library = splitter(path), Tokenizer.from_file(path)
    words = Counter((r.word, r.ids) for r in bpe.distinct_words(frame(spark), path).collect())
    assert set(words.values()) == {1} and {w for w, _ in words} == {w for r in documents() for w in split.words(r[1] or "")}
    assert all(list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(w, add_special_tokens=False).ids for w, ids in words)


@pytest.mark.parametrize("chars, page", [(1, 1), (500, 40), (12_000_000, 16_384)])
def test_chunks_and_pages(spark, monkeypatch, chars, page):
    path, library = bpe.vocabulary("byte_bpe_50k.json"), Tokenizer.from_file(bpe.vocabulary("byte_bpe_50k.json"))
    monkeypatch.setattr(bpe, "CHUNK_CHARS", chars)
    monkeypatch.setattr(bpe, "PAGE_WORDS", page)
    rows = [(None, prose(i, i)) for i in range(60)] + [(None, None), (7, ""), *[(7, "one id on many rows " * k) for k in range(40)]]
    coded = bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), path)
    ids = lambda t: struct.pack(f"<{len(x := library.encode(t or '', add_special_tokens=False).ids)}I", *x)
    assert Counter((r.doc_id, bytes(r.ids)) for r in coded.collect()) == Counter((i, ids(t)) for i, t in rows)


def test_splits_may_change_between_actions(spark):
    """The table of words stands once written; how later actions split the input is all the same."""
    library = Tokenizer.from_file(bpe.vocabulary("byte_bpe_50k.json"))
    rows = [(i, prose(i, 40)) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.option("parquet.block.size", 20_000).parquet(path := fresh(spark, "in"))
    coded, key = bpe.encode(spark.read.parquet(path), bpe.vocabulary("byte_bpe_50k.json")), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        found = []
        for size in ("128m", "20k"):
            spark.conf.set(key, size)
            found.append(Counter((r.doc_id, bytes(r.ids)) for r in coded.select("*").collect()))
    finally:
        spark.conf.set(key, before)
    assert found[0] == found[1] == Counter((i, struct.pack(f"<{len(x := library.encode(t, add_special_tokens=False).ids)}I", *x)) for i, t in rows)


def test_ids_outside_the_vocabulary(spark):
    odd = spark.createDataFrame([(1, struct.pack("<2I", 64, 4_000_000)), (2, None)], "doc_id bigint, ids binary")
    path = bpe.vocabulary("byte_bpe_50k.json")
    assert {(r.doc_id, r.decoded) for r in bpe.decode(odd, path).collect()} == {(1, Tokenizer.from_file(path).decode([64, 4_000_000])), (2, "")}


def test_shards_read_back(spark):
    library = Tokenizer.from_file(bpe.vocabulary("word_bpe_49k.json"))
    manifest = sstable.write_shards(frame(spark), fresh(spark, "shards"))
    found = sorted(sstable.read_shards(spark, manifest).collect(), key=lambda r: r.start)
    rows = sorted([(r[0], r[1] or "") for r in documents()], key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in found] == [r[0] for r in rows]
    start, by_id = 0, {}
    for r in found:
        assert r.start == start
        start += r.n_tokens
    for doc_id, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        by_id.setdefault(doc_id, []).append(zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
    assert Counter((r.doc_id, r.ids_crc32) for r in found) == Counter((k, c) for k, v in by_id.items() for c in v)
    for doc_id in (1, 2, 9, -5, None):
        assert Counter(zlib.crc32(ids.astype("<u4").tobytes()) for ids in sstable.lookup(manifest, doc_id)) == Counter(by_id[doc_id])
    assert sstable.lookup(manifest, 4711) == []


def test_one_id_on_many_rows_spans_shards(spark):
    rows = [(i, f"{i} one") for i in range(40)] + [(None, f"null {k}") for k in range(900)] + [(50, f"many {k} rows") for k in range(900)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        manifest = sstable.write_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), fresh(spark, "shards"))
    finally:
        spark.conf.unset(key)
    assert len(manifest) > 2 and max(r["n_docs"] for r in manifest) < 900
    assert [len(sstable.lookup(manifest, k)) for k in (None, 50, 3, 99)] == [900, 900, 1, 0]
    found = sorted(sstable.read_shards(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted([r[0] for r in rows], key=lambda i: (i is not None, i or 0))
    starts = [0]
    for r in found:
        starts.append(starts[-1] + r.n_tokens)
    assert [r.start for r in found] == starts[:-1]


def test_blocks_index_and_filter(tmp_path):
    rng = random.Random(3)
    keys = sorted(rng.randrange(-(10**12), 10**12) for _ in range(3000))
    entries = [(k, struct.pack("<5H", *[rng.randrange(49_000) for _ in range(5)]) * 20) for k in keys]
    path = tmp_path / "x.sst"
    path.write_bytes(b"".join(sstable.Writer(2).chunks(iter(entries))))
    reader = sstable.Reader(str(path))
    assert len(reader.index) > 3 and [i for i, _, _ in reader.scan()] == keys
    assert all(reader.get(k)[0].tobytes() == v for k, v in entries[::50])
    assert sum(bool(all(reader.bloom[p >> 3] >> (p & 7) & 1 for p in sstable._probes(sstable.key_of(k + 1), reader.bits))) for k in keys if k + 1 not in keys) < 100


def test_grammars_on_held_out_strings():
    model = grammar.default_model()
    for label, found in grammar.labelled(100, 99).items():
        assert sum(map(model.is_credential, found)) >= 97, label
    ordinary = [s for v in grammar.ordinary(150, 55).values() for s in v]
    assert sum(map(model.is_credential, ordinary)) <= len(ordinary) // 200


def test_automaton_merges_and_sums_to_one():
    a = grammar.Automaton(["ab" * n for n in range(1, 9)] * 20)
    assert len(a.states) < 17
    for s in a.states:
        assert a.ends[s] + sum(n for _, n in a.moves[s].values()) == a.visits[s]


def brute(text):
    import re

    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "apikey", "ſecret", "secret", ":", "=", " ", '"', "'", "AKIA", "ABCDEF012345", "0123456789abcdef", "0123456789abcdef" * 2, "short", "longer_value", "é", "\n", "-", "."])).map("".join))
def test_base_spans(text):
    assert secrets.find(text, None) == brute(text)


def test_scan_and_mask(spark):
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(frame(spark)).collect() if r.doc_id == 11}[11]
    text = next(r[1] for r in documents() if r[0] == 11)
    assert [k for k, _, _ in spans] == ["assign", "hex", "access", "assign"]
    masked = secrets.mask(frame(spark))
    assert masked.columns == frame(spark).columns and masked.count() == len(documents())
    row = masked.filter("doc_id = 11").first()
    assert "AKIA" not in row.text and "0123456789abcdef" not in row.text and row.n_chars == len(row.text) < len(text)
    assert masked.filter("doc_id = 9").first().text == next(r[1] for r in documents() if r[0] == 9)


def digits_of(chars, n, seed):
    """A string of a format, drawn from SHA-256 and not by the trainer."""
    big = int.from_bytes(b"".join(hashlib.sha256(f"{seed}:{k}".encode()).digest() for k in range(1 + n // 30)), "big")
    return "".join(chars[big // len(chars) ** k % len(chars)] for k in range(n))


ALNUM = string.ascii_letters + string.digits


def test_recall_and_precision_on_strings_of_another_source():
    model, url64, upper = grammar.default_model(), ALNUM + "_-", string.ascii_uppercase + string.digits
    formats = {
        "cloud_access": lambda k: "AKIA" + digits_of(upper, 16, k), "cloud_secret": lambda k: digits_of(ALNUM + "+/", 40, k), "forge_token": lambda k: "ghp_" + digits_of(ALNUM, 36, k), "maps_key": lambda k: "AIza" + digits_of(url64, 35, k), "pay_key": lambda k: "sk_live_" + digits_of(ALNUM, 24, k),
        "chat_token": lambda k: f"xoxb-{digits_of(string.digits, 12, k)}-{digits_of(string.digits, 12, -k - 1)}-{digits_of(ALNUM, 24, k)}", "web_token": lambda k: f"eyJ{digits_of(url64, 33, k)}.eyJ{digits_of(url64, 60 + k % 20, k)}.{digits_of(url64, 43, -k - 1)}",
    }
    for label, draw in formats.items():
        assert sum(model.is_credential(draw(k)) and model.label(draw(k))[1] == label for k in range(200)) > 190, label
    clean = {
        "words of 20": lambda k: digits_of(ALNUM, 20, k), "words of 36": lambda k: digits_of(ALNUM, 36, k), "base64 lines": lambda k: digits_of(ALNUM + "+/", 64, k), "upper hex": lambda k: digits_of("0123456789ABCDEF", 40, k), "hex": lambda k: digits_of("0123456789abcdef", 40, k), "other prefix": lambda k: "abc_" + digits_of(ALNUM, 36, k),
        "short": lambda k: "ghp_" + digits_of(ALNUM, 20, k), "near": lambda k: "AKIB" + digits_of(upper, 16, k), "uuid": lambda k: "-".join(digits_of("0123456789abcdef", n, k) for n in (8, 4, 4, 4, 12)), "slug": lambda k: f"release-notes-for-version-{k}-of-2024",
    }
    for label, draw in clean.items():
        assert sum(model.is_credential(draw(k)) for k in range(200)) < 10, label


def test_formats_beyond_the_base():
    model, key = grammar.default_model(), "ghp_" + digits_of(ALNUM, 36, 1)
    secret = digits_of(ALNUM + "+", 40, 5)
    for before, after in (("see ", " there"), ("see ", "."), ("GITHUB=", " x"), ("https://git.example.com/", "/hooks/a1"), ("a=1/", ".tar.gz"), ("...", "=="), ("é😀 ", "")):
        assert secrets.find(before + key + after, model) == [(len(before), 3, len(before) + len(key))]
    text = f"see KEY={secret}. And https://hooks.example.com/{key}/{key}."
    at = [text.index(secret), text.index(key), text.rindex(key)]
    assert secrets.find(text, model) == [(at[0], 3, at[0] + 40), *[(a, 3, a + 40) for a in at[1:]]]
    assert secrets.masked(text, secrets.find(text, model)) == "see KEY=[secret]. And https://hooks.example.com/[secret]/[secret]."
    for clean in ("write to bosbt.42@mail8.example.com now", "id 550e8400-e29b-41d4-a716-446655440000", "card 4785380592391139", "plain words only", "GET /a/b1/c2/dddddddddddddddd/e.html?x=1"):
        assert secrets.find(clean, model) == []


def test_query_columns(spark):
    rows = [*documents(), (50, f"see KEY=ghp_{digits_of(ALNUM, 36, 3)}. password: longer_value", "en", "a")]
    frame(spark, rows).write.parquet((folder := fresh(spark, "in")) + "/documents.parquet")
    model, names = grammar.default_model(), ["assign", "access", "hex", "format"]
    told = lambda spans: ",".join(f"{names[k]}:{a}:{e}" for a, k, e in spans)
    want = Counter()
    for doc_id, text, *_ in rows:
        base, every = brute(text or ""), secrets.find(text or "", model)
        assert [x for x in every if x[1] < 3] == base
        want[(doc_id, *[sum(k == i for _, k, _ in every) for i in range(4)], hashlib.sha256(told(base).encode()).hexdigest(), told(every))] += 1
    found = secrets.op2_secret_scans(spark, folder).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.n_format, r.base_sha256, r.spans) for r in found) == want
    assert next(r for r in found if r.doc_id == 50).spans == "format:8:48,assign:50:72"


@pytest.mark.parametrize("run", [secrets.scan, secrets.mask, bpe.round_trip])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], DOCS)).count() == 0


def test_empty_shards(spark):
    assert sstable.read_shards(spark, sstable.write_shards(spark.createDataFrame([], DOCS), fresh(spark, "none"))).count() == 0
