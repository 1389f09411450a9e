"""Fill-in-middle transformation: whole batches are cut into prefix, middle and suffix by numpy on Arrow's UTF-8 buffers.

A look-up table gives every byte a class; a mask over adjacent bytes marks where
units (lines with their newline) begin; one cumulative sum over the batch, taken
relative to each document's first byte, counts the units; ``searchsorted`` in
that sum finds the cuts of all rows together. The parts are never copied row by
row: three offsets a row over the same data buffer make one Arrow array of all
parts, which Arrow joins with the markers.

Memory of a block is about nine bytes for each byte of its texts; blocks hold
``BLOCK`` bytes unless a single text is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spare_name, table, text_blocks

MARKERS = ("<P>", "<S>", "<M>")
#: Rows and bytes of the texts cut together.
BLOCK = (4000, 8 << 20)
_OTHER, _NEWLINE, _CONTINUATION, _MARKER = range(4)
PLAIN, PSM, SPM = range(3)
_FORMS = pa.array(["plain", "psm", "spm"])
_KIND = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def check_markers(markers) -> tuple[bytes, ...]:
    """Markers as bytes. No end of one may begin another and none may contain another, so that joined parts come apart in one way only."""
    coded = tuple(m.encode() for m in markers)
    if len(coded) != 3 or len(set(coded)) != 3:
        raise ValueError("three different markers are needed")
    for a in coded:
        if not a or a[0] >= 0x80 or b"\n" in a:
            raise ValueError(f"marker {a!r} must begin with an ASCII character and hold no newline")
        for b in coded:
            if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"markers {a!r} and {b!r} overlap")
    return coded


def _classes(markers) -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[0x80:0xC0] = _CONTINUATION
    kinds[ord("\n")] = _NEWLINE
    kinds[[m[0] for m in markers]] = _MARKER
    return kinds


def _buffers(texts: pa.Array) -> tuple:
    """Row offsets from 0, bytes, and the strings as 64-bit Arrow arrays use them; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2] or pa.py_buffer(b"")
    data = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    return offsets - offsets[0], np.frombuffer(data, np.uint8), data


def _parts(bounds: np.ndarray, last: int, data) -> list:
    """Columns of parts: row k has its c-th part from bounds[k, c] to the next bound (its own, or the next row's first)."""
    flat = np.append(bounds.ravel(), last).astype(np.int64)
    every = pa.LargeStringArray.from_buffers(len(flat) - 1, pa.py_buffer(flat), data)
    return [every.take(pa.array(np.arange(c, len(flat) - 1, bounds.shape[1]))) for c in range(bounds.shape[1])]


def _pick(which: np.ndarray, *values) -> pa.Array:
    """For each row the value (array or text) that ``which`` numbers."""
    return pc.choose(pa.array(which.astype(np.int64)), *[pa.scalar(v, pa.large_string()) if isinstance(v, str) else v for v in values])


def _hits(data, kinds, marker: bytes, offsets) -> tuple[np.ndarray, np.ndarray]:
    """Where a marker stands inside a row, and the rows."""
    at = np.flatnonzero(kinds == _MARKER)
    at = at[at <= len(data) - len(marker)]
    for j, byte in enumerate(marker):
        at = at[data[at + j] == byte]
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + len(marker) <= offsets[row + 1]
    return at[inside], row[inside]


def transform_block(texts: pa.Array, draws: list[np.ndarray], markers=MARKERS, fim_percent: int = 100, spm_percent: int = 50) -> pa.StructArray:
    """The kernel: number of units, form, characters of prefix and middle, output, for a block of texts and their four numbers each."""
    coded = check_markers(markers)
    offsets, data, buffer = _buffers(texts)
    kinds = _classes(coded)[data]
    starts = np.zeros(len(data), bool)
    starts[1:] = kinds[:-1] == _NEWLINE
    starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    count = np.zeros(len(data) + 1, np.int32 if len(data) < 2**31 else np.int64)
    np.cumsum(starts, out=count[1:])
    del starts
    before = count[offsets[:-1]].astype(np.int64)
    n = count[offsets[1:]] - before
    h1, h2, h3, h4 = draws
    a, b = h1 % (n + 1), h2 % (n + 1)
    # unit u of a row begins where the running count first exceeds what stood before the row by u + 1; past its last unit that is the next row's begin
    cut_a, cut_b = (np.searchsorted(count[1:], (before + u + 1).astype(count.dtype), "left") for u in (np.minimum(a, b), np.maximum(a, b)))
    del count
    form = np.where(h4 % 100 < spm_percent, SPM, PSM)
    form[(offsets[:-1] == offsets[1:]) | (h3 % 100 >= fim_percent)] = PLAIN
    for m in coded:
        form[_hits(data, kinds, m, offsets)[1]] = PLAIN
    plain = form == PLAIN
    chars = np.zeros(len(data) + 1, np.int32 if len(data) < 2**31 else np.int64)
    np.cumsum(kinds != _CONTINUATION, out=chars[1:])
    prefix_chars, middle_chars = (chars[cut_a] - chars[offsets[:-1]]).astype(np.int64), (chars[cut_b] - chars[cut_a]).astype(np.int64)
    del chars, kinds
    cut_a, cut_b = np.where(plain, offsets[1:], cut_a), np.where(plain, offsets[1:], cut_b)
    prefix, middle, suffix = _parts(np.stack([offsets[:-1], cut_a, cut_b], 1), offsets[-1], buffer)
    p, s, m = markers
    output = pc.binary_join_element_wise(
        _pick(form, "", p, s), _pick(form, prefix, prefix, suffix), _pick(form, "", s, p), _pick(form, suffix, suffix, prefix), _pick(form, "", m, m), middle,
        pa.scalar("", pa.large_string()),
    )
    columns = [pa.array(n.astype(np.int64)), _FORMS.take(pa.array(form)), pa.array(prefix_chars, mask=plain), pa.array(middle_chars, mask=plain), output.cast(pa.string())]
    return pa.StructArray.from_arrays(columns, ["n", "form", "prefix_chars", "middle_chars", "output"])


def restore_block(outputs: pa.Array, forms: pa.Array, markers=MARKERS) -> pa.Array:
    """The texts that outputs and their forms came from; null for what is no output of its form."""
    coded = check_markers(markers)
    form = pc.index_in(forms, value_set=_FORMS).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    null = (form < 0) | outputs.is_null().to_numpy(zero_copy_only=False)
    offsets, data, buffer = _buffers(outputs)
    kinds = _classes(coded)[data]
    found = [_hits(data, kinds, m, offsets) for m in coded]
    at = np.concatenate([x[0] for x in found])
    which = np.repeat(np.arange(3), [len(x[0]) for x in found])
    row = np.concatenate([x[1] for x in found])
    order = np.argsort(at, kind="stable")
    at, which, row = at[order], which[order], row[order]
    # rows with three markers, the first of them at the row's begin, in the order of their form
    first = np.searchsorted(row, np.arange(len(outputs)))
    three = (np.bincount(row, minlength=len(outputs)) == 3) if len(outputs) else np.zeros(0, bool)
    cut = three & (form > PLAIN)
    lead, want = first[cut], np.where((form[cut] == PSM)[:, None], [[0, 1, 2]], [[1, 0, 2]])
    good = (at[lead] == offsets[:-1][cut]) & np.all(which[lead[:, None] + np.arange(3)] == want, axis=1) if len(lead) else np.zeros(0, bool)
    bad = form > PLAIN
    bad[np.flatnonzero(cut)[good]] = False
    null |= bad
    bounds = np.repeat(offsets[1:, None], 6, 1)
    bounds[:, :2] = offsets[:-1, None]
    rows, lead = np.flatnonzero(cut)[good], lead[good]
    sizes = np.array([len(m) for m in coded])
    for k in range(3):
        bounds[rows, 2 * k] = at[lead + k]
        bounds[rows, 2 * k + 1] = at[lead + k] + sizes[which[lead + k]]
    _, one, _, two, _, three = _parts(bounds, offsets[-1], buffer)
    form = np.maximum(form, 0)
    text = pc.binary_join_element_wise(_pick(form, one, one, two), three, _pick(form, two, two, one), pa.scalar("", pa.large_string()))
    return pc.if_else(pa.array(null), pa.scalar(None, pa.string()), text.cast(pa.string()))


def fill_in_middle(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, markers=MARKERS, out: str = "fim") -> DataFrame:
    """Append ``out``: a struct of n (lines), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output.

    Cuts and form follow from the SHA-256 of ``seed:id``, so a document is cut
    alike wherever it lies. Null and empty texts and texts that hold a marker
    stay plain (null: an empty output); null identifiers count as an empty one;
    repeated rows are cut alike; a text of any length is cut as a whole. A column
    already named ``out`` is replaced, all others pass unchanged. No shuffle.
    """
    check_markers(markers)
    small_batches(df.sparkSession)

    @F.arrow_udf(_KIND)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, *draws in batches:
            at, numbers = 0, [d.to_numpy(zero_copy_only=False) for d in draws]
            for block in text_blocks(texts, *BLOCK):
                yield transform_block(block, [d[at : at + len(block)] for d in numbers], markers, fim_percent, spm_percent)
                at += len(block)

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    held = spare_name(df, "_digest")
    draws = [F.conv(F.substring(held, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]
    return df.withColumn(held, digest).withColumn(out, run(F.col(text_col), *draws)).drop(held)


def restore_texts(df: DataFrame, output_col: str = "output", form_col: str = "form", *, markers=MARKERS, out: str = "restored") -> DataFrame:
    """Append ``out``: the text that ``fill_in_middle`` was given, from its output and form.

    Null where the output is null, the form unknown, or the markers do not
    stand as the form says. A column already named ``out`` is replaced. No shuffle.
    """
    check_markers(markers)
    small_batches(df.sparkSession)

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            at = 0
            for block in text_blocks(outputs, *BLOCK):
                yield restore_block(block, forms.slice(at, len(block)), markers)
                at += len(block)

    return df.withColumn(out, run(F.col(output_col), F.col(form_col)))


def op13_fill_in_middle(spark, sf_dir):
    """Contract: doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text rebuilt from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = fill_in_middle(docs).select("doc_id", "fim.*")
    return restore_texts(cut).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


def oracle() -> str:
    """The contract as DuckDB SQL."""
    draw = lambda k: f"cast('0x' || substr(h, {8 * k + 1}, 8) as bigint)"
    held = " or ".join(f"contains(t, '{m}')" for m in MARKERS)
    join = lambda a, b: f"array_to_string(u[{a}:{b}], '')"
    return f"""
with split as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') u,
    sha256('7:' || coalesce(cast(doc_id as varchar), '')) h from documents),
drawn as (
  select doc_id, t, u, len(u) n, {draw(0)} % (len(u) + 1) x, {draw(1)} % (len(u) + 1) y,
    case when t = '' or {held} then 'plain' when {draw(3)} % 100 < 50 then 'spm' else 'psm' end form from split),
cut as (
  select *, {join(1, 'least(x, y)')} p, {join('least(x, y) + 1', 'greatest(x, y)')} m, {join('greatest(x, y) + 1', 'n')} s from drawn)
select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
  sha256(t) restored_sha256
from cut"""
