"""Secret scans: fixed base patterns, and credentials recognised by inferred format grammars.

Base spans are found as the patterns say. Every other maximal run of 16 or more of ``[A-Za-z0-9+/_.=-]`` that touches no
base span is a candidate, and where it is not a credential so are its parts between ``=``, then between ``/``, then between
``.``. Candidates lose ``.``, ``=`` and ``-`` at both ends and need 16 characters, a letter and a digit; the automata of
:mod:`.grammar` score them, and those above the threshold become spans of kind ``format``, just as long as what was
scored. The automata are trained on the driver from a fixed number of labelled strings and sent with the tasks (some
kB); documents are scanned where they lie, without a shuffle.

Edge cases: a null text counts as empty and has no spans; repeated rows and ids each get their row; a null id stays
null; extra columns are ignored by :func:`scan` and kept by :func:`mask`; an empty table gives an empty table. Spans
are in code points. Texts of any length are scanned whole.
"""

from __future__ import annotations

import pickle
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table
from .grammar import Model, default_model

KINDS = ("assign", "access", "hex", "format")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS, CANDIDATE_CHARS = 8, 16, 32, 16
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_NAME = re.compile(r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk]")
_LETTER, _DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
REPLACEMENT = "[secret]"


def credentials(word: str, at: int, model: Model, marks: str = "=/.") -> list[tuple[int, int, int]]:
    """Spans of the credentials in a run that starts at ``at``: the run, or else its parts, coarse before fine."""
    body = word.strip(".=-")
    if len(body) < CANDIDATE_CHARS or not (_DIGIT.search(body) and _LETTER.search(body)):
        return []
    at += len(word) - len(word.lstrip(".=-"))
    if model.is_credential(body):
        return [(at, 3, at + len(body))]
    for k, mark in enumerate(marks):
        if mark in body:
            out = []
            for part in body.split(mark):
                out += credentials(part, at, model, marks[k + 1 :])
                at += len(part) + 1
            return out
    return []


def find(text: str, model: Model | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, sorted. Access and hex spans lie within runs, which are looked for once."""
    out = []
    if _NAME.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    runs = []
    for run in _RUN.finditer(text):
        word, at = run.group(), run.start()
        runs.append((at, run.end(), word))
        if "AKIA" in word:
            out += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(word) if m.end() - m.start() >= ACCESS_CHARS]
        if len(word) >= HEX_CHARS:
            out += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(word) if m.end() - m.start() >= HEX_CHARS]
    if runs and model is not None:
        base = list(out)
        for a, b, word in runs:
            if not any(s < b and a < e for s, _, e in base):
                out += credentials(word, a, model)
    return sorted(out)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(model: bytes):
    def run(batches):
        grammar = pickle.loads(model)
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(text.as_py() or "", grammar)] for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _ARROW)], names=["doc_id", "spans"])

    return run


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and ``spans``: array of (kind, start, end), by start and kind."""
    slim = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    return slim.mapInArrow(_scan(pickle.dumps(model or default_model())), T.StructType([slim.schema["doc_id"], T.StructField("spans", SPANS)]))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced."""
    out, at, covered = [], 0, -1
    for a, _, b in spans:
        if a >= covered:
            out += [text[at:a], REPLACEMENT]
        covered = max(covered, b)
        at = covered
    return "".join(out) + text[at:]


def _mask(model: bytes, text_at: int, chars_at: int | None):
    def run(batches):
        grammar = pickle.loads(model)
        for batch in batches:
            texts = [None if (s := t.as_py()) is None else masked(s, find(s, grammar)) for t in batch.column(text_at)]
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            if chars_at is not None:
                columns[chars_at] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def mask(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns as they came, secrets in ``text`` replaced and ``n_chars``, if there is one, counted anew."""
    small_batches(docs.sparkSession)
    names = docs.columns
    chars = names.index("n_chars") if "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, T.IntegralType) else None
    return docs.mapInArrow(_mask(pickle.dumps(model or default_model()), names.index("text"), chars), docs.schema)


def op2_secret_scans(spark, sf_dir: str) -> DataFrame:
    spans = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return spans.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "format")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("format").alias("n_format"),
    )
