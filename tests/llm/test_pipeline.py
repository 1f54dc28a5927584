"""The pipeline against a version in plain Python, stage by stage and as a whole."""

import hashlib
import struct
from collections import defaultdict

import corpus_pipeline
import pytest
from ringspan.llm import grammar, mixing, quality_rules, secrets
from ringspan.llm.bpe import vocabulary
from ringspan.llm.common import fresh
from tokenizers import Tokenizer

from .test_fixtures import DOCS, documents, frame
from .test_joins import WORD, classes, near_rows
from .test_native import measures

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(row):
    n, chars, symbols, dup, repeat, lines = measures(row[1])
    failed = {"too_few_words": n < 10, "repeated_words": 100 * repeat > 20 * n, "symbols": 100 * symbols > 25 * n, "duplicate_lines": dup >= 3 and 100 * dup > 40 * lines, "long_words": chars > 20 * n}
    assert set(failed) == set(quality_rules.RULES)
    return not any(failed[r] for r in quality_rules.POLICIES[quality_rules.CURRENT])


def one_of_each(rows):
    """Row numbers that stay: of each class the rows with its least id, and of those one."""
    classed, seen, out = defaultdict(list), set(), []
    for i, j in ((i, j) for i in range(len(rows)) for j in range(i)):
        if next(iter(classes([(0, rows[i][1]), (1, rows[j][1])])))[2]:
            classed[i].append(j)
            classed[j].append(i)
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in classed[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        out.append(min(group, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)))
    return [rows[i] for i in sorted(out)]


def layout_of(text):
    n = len(WORD.findall(text))
    return "table" if n and 5 * text.count("|") >= n else "note" if n < 100 else "article" if n < 600 else "report"


def taken(rows):
    """Raking in plain Python, then the draws."""
    cell = lambda r: (r[3] or "", r[2] or "", layout_of(r[1]))
    tokens = defaultdict(int)
    for r in rows:
        tokens[cell(r)] += len(WORD.findall(r[1]))
    total, weight, goals = sum(tokens.values()), {c: mixing.FRACTION * n for c, n in tokens.items()}, []
    for d, name in enumerate(mixing.DIMENSIONS):
        held = defaultdict(int)
        for c, n in tokens.items():
            held[c[d]] += n
        share = {v: (n / total) ** mixing.TEMPER[name] if n else 0.0 for v, n in held.items()}
        goals.append({v: mixing.FRACTION * total * s / sum(share.values()) for v, s in share.items()})
    for _ in range(mixing.ROUNDS):
        for d in range(3):
            have = defaultdict(float)
            for c, w in weight.items():
                have[c[d]] += w
            weight = {c: min(tokens[c], w * goals[d][c[d]] / have[c[d]] if have[c[d]] else 0.0) for c, w in weight.items()}
    u = lambda i: int(hashlib.sha256(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()[:12], 16) / (1 << 48)
    return [r for r in rows if u(r[0]) < (weight[cell(r)] / tokens[cell(r)] if tokens[cell(r)] else 1.0)]


def hard_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, one id on many rows."""
    rows = near_rows() + documents()[:1] + [(None, f"a text without an id, number {i}, of ten words or a few more", None, None) for i in range(12)]
    rows += [(900, f"one id stands for text number {i} and that is {i} of many", "en", "hot") for i in range(15)] + [(901, documents()[11][1], "en", "a")] * 2
    cases = [[r[k] for r in rows] for k in range(4)]
    assert all(None in c for c in cases) and "" in cases[1] and max(len(t or "") for t in cases[1]) > 150_000 and len(set(rows)) < len(rows)
    return rows


@pytest.mark.parametrize("columns", [COLUMNS, None])
def test_pipeline_matches_brute_force(spark, columns):
    """With the columns of documents alone, and with extra ones that carry the operators' own names."""
    rows = hard_rows()
    docs = frame(spark, rows)
    docs.select(columns or docs.columns).repartition(3).write.parquet((folder := fresh(spark, "in")) + "/documents.parquet")
    model, want = grammar.default_model(), [r for r in rows if good(r)]
    want = one_of_each(want)
    want = taken([(r[0], secrets.masked(r[1], secrets.find(r[1], model)), *r[2:]) for r in want])
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    told = set()
    for doc_id, text, *_ in want:
        ids = library.encode(text, add_special_tokens=False).ids
        told.add((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    found = corpus_pipeline.run(spark, folder).collect()
    assert len(found) == len(want) > 5 and {tuple(r) for r in found} == told


def test_stages_keep_the_columns(spark):
    docs = frame(spark).select(COLUMNS)
    docs.write.parquet(path := fresh(spark, "in"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.read.parquet(path), "")
        assert out.columns == COLUMNS, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name


def test_stages_of_an_empty_table(spark):
    spark.createDataFrame([], DOCS).select(COLUMNS).write.parquet(path := fresh(spark, "in"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(path), "").count() == 0, name
