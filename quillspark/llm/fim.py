"""Fill-in-middle transformation: texts cut in three at seeded unit boundaries, the middle last.

The matcher is streaming: a first pass over a lazy iterator of matches counts the units, a second one advances another such
iterator to the two ranks and keeps only where they end. No array of units is ever held, so memory is that of the text and
of its output. Prefix and middle end after as many units as two hashes of the id say; what follows is the suffix.

Defined cases: a null text is empty. Texts that are empty or hold a mark, and those that the share leaves out, stay as they
are (plain). Very long texts are taken whole. Repeated rows give repeated results; a null id is hashed as an empty one.
Where both ranks agree the middle is empty; a prefix or suffix may be, too. An empty table gives an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, frame, id_type, small_batches, typed

LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Marks:
    """What begins each part. No end of a mark may begin one, so that a text without marks can be told from them again."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        three = (self.prefix, self.suffix, self.middle)
        if len({*three}) < 3 or not all(three) or any(a != b and a in b for a in three for b in three):
            raise ValueError(f"three different marks are needed, none within another: {three}")
        if any(b.startswith(a[i:]) for a in three for b in three for i in range(1, len(a))):
            raise ValueError(f"the end of a mark begins another: {three}")


def hashes(seed: int, key: object) -> list[int]:
    """Four unsigned numbers of 32 bits."""
    found = sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(found[i : i + 4], "big") for i in (0, 4, 8, 12)]


def ends(text: str, unit: re.Pattern, ranks: tuple[int, ...]) -> list[int]:
    """Where the units of the given ranks (ascending, from 1; 0: none) end."""
    matches, passed, at, out = unit.finditer(text), 0, 0, []
    for rank in ranks:
        if rank > passed:
            at, passed = next(islice(matches, rank - passed - 1, None)).end(), rank
        out.append(at)
    return out


def transformed(text: str, key: object, unit: re.Pattern, marks: Marks, seed: int, percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output."""
    n = sum(1 for _ in unit.finditer(text))
    h1, h2, h3, h4 = hashes(seed, key)
    if not text or marks.prefix in text or marks.suffix in text or marks.middle in text or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = ends(text, unit, tuple(sorted((h1 % (n + 1), h2 % (n + 1)))))
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, "".join((marks.suffix, text[b:], marks.prefix, text[:a], marks.middle, text[a:b]))
    return n, "psm", a, b - a, "".join((marks.prefix, text[:a], marks.suffix, text[b:], marks.middle, text[a:b]))


TURNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def turn_batches(batches: Iterator[pa.RecordBatch], *how) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        rows = [transformed(text or "", key, *how) for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield frame(dict(zip(TURNED.names[1:], zip(*rows, strict=True), strict=True)) | {"doc_id": b.column(0)}, typed(TURNED, b))


def fill_in_middle(docs: DataFrame, unit: str = LINES, marks: Marks = Marks(), seed: int = 7, percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain), output of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pattern = re.compile(unit)
    return arrow_map(rows, lambda it: turn_batches(it, pattern, marks, seed, percent, spm_percent), f"doc_id {id_type(rows)}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The exact text, from output and form alone."""
    p, s, m = F.lit(marks.prefix), F.lit(marks.suffix), F.lit(marks.middle)
    part = lambda c, mark, i: F.split_part(c, mark, F.lit(i))
    middle = part(output, m, 2)
    psm = F.concat(part(part(output, s, 1), p, 2), middle, part(part(output, s, 2), m, 1))
    spm = F.concat(part(part(output, p, 2), m, 1), middle, part(part(output, p, 1), s, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(turned: DataFrame, marks: Marks = Marks()) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return turned.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"), marks)).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS s FROM d),
f AS (SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 100 THEN 'plain' WHEN s < 50 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS e FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE p || m || e END) AS restored_sha256
FROM f
"""
