"""Text and JSON reports. Inputs are collected summaries: one row a file, a cycle, a length or a quality value.

Numbers are formatted here, by Python, whose fixed formats round exact ties to even.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row

CURVES = ("A", "T", "C", "G", "mean")
CONTENTS = ("A", "T", "C", "G", "N", "GC")


def fixed(value: float, decimals: int = 6) -> str:
    return f"{value:.{decimals}f}"


def whole(n: int, comma: bool = False) -> str:
    return f"{n:,}" if comma else str(n)


def short(value: float) -> str:
    """Six significant digits, as streams print by default."""
    return f"{value:.6g}"


def summary_text(summary: Row, curve: Iterable[Row], decimals: int = 6, percent: bool = False) -> str:
    """The summary for people, with the mean quality of every k-th cycle."""
    pct = " %" if percent else ""
    s = summary.asDict()
    row = lambda label, n, rate=None, unit="": f"  {label:<20} {n:>12,}" + (f"  ({fixed(rate, decimals)}{pct})" if rate is not None else unit)
    lines = ["=== QC Summary ===", row("Total reads:", s["total_reads"]), row("Total bases:", s["total_bases"]), row("Mean length:", s["mean_length"], unit=" bp"), row("GC bases:", s["gc_bases"], s["gc_content"])]
    lines += [row(f"Q{q} bases:", s[f"q{q}_bases"], s[f"q{q}_rate"]) for q in (20, 30, 40)]
    lines += [row("Total cycles:", s["total_cycles"]), row("Cycle 20 Q20:", s["cycle20_bases"], s["cycle20_rate"]), "", "  Per-cycle mean quality (sampled):", "    Cycle   MeanQual"]
    step = max(1, s["total_cycles"] // 25)
    lines += [f"    {r['cycle']:>5}   {r['mean_qual']:7.2f}" for r in sorted(curve, key=lambda r: r["cycle"]) if (r["cycle"] - 1) % step == 0]
    return "\n".join(lines) + "\n"


_SCALARS = ["total_reads", "total_bases", "mean_length", "total_cycles", "q20_bases", "q20_rate", "q30_bases", "q30_rate", "q40_bases", "q40_rate", "gc_bases", "gc_content", "cycle20_bases", "cycle20_rate"]


def _number(value: float | int, decimals: int, comma: bool) -> str:
    if isinstance(value, float):
        return fixed(value, decimals)
    return f'"{value:,}"' if comma else str(value)


def read_json(summary: Row, lengths: Iterable[Row], curve: Iterable[Row], qualities: Iterable[Row], decimals: int = 6, percent: bool = False, comma: bool = False) -> str:
    """The JSON object of one file's read statistics."""
    s = summary.asDict()
    total = max(1, s["total_reads"])
    lengths, curve = sorted(lengths, key=lambda r: r["length"]), sorted(curve, key=lambda r: r["cycle"])
    members = [f'"{k}": {_number(s[k], decimals, comma)}' for k in _SCALARS]
    members.append('"length_histogram": {' + ", ".join(f'"{r["length"]}": {_number(r["n"], decimals, comma)}' for r in lengths) + "}")
    members.append('"length_histogram_percent": {' + ", ".join(f'"{r["length"]}": {fixed((100.0 if percent else 1.0) * r["n"] / total, decimals)}' for r in lengths) + "}")
    series = lambda name: "[" + ",".join(short(r[name]) for r in curve) + "]"
    members.append('"quality_curves": {' + ", ".join(f'"{c}":{series("mean_qual" if c == "mean" else f"{c}_qual")}' for c in CURVES) + "}")
    members.append('"content_curves": {' + ", ".join(f'"{c}":{series(f"{c}_content")}' for c in CONTENTS) + "}")
    members.append('"quality_histogram": {' + ", ".join(f'"{r["qual_ascii"]}": {r["n"]}' for r in sorted(qualities, key=lambda r: r["qual_ascii"])) + "}")
    return "{" + ", ".join(members) + "}"


def document(reads: dict[str, str], combined: Row | None, duplication: Row, insert: tuple[Row, Iterable[Row]] | None, decimals: int = 6, percent: bool = False, comma: bool = False) -> str:
    """The JSON document of one file or a pair, indented; ``reads``: label to :func:`read_json`."""
    members = [f'"{k}": {v}' for k, v in reads.items()]
    if combined is not None:
        members += [f'"{k}": {_number(combined[k], decimals, comma)}' for k in _SCALARS]
    rate = duplication["dup_rate"] * (100.0 if percent else 1.0)
    members.append(f'"duplication": {{"total": {duplication["total"]}, "duplicates": {duplication["duplicates"]}, "rate": {fixed(rate, decimals)}}}')
    if insert is not None:
        peak, hist = insert
        members.append(f'"insert_size": {{"peak": {peak["peak"]}, "unknown": {peak["unknown"]}, "histogram": [{",".join(str(r["n"]) for r in sorted(hist, key=lambda r: r["insert_size"]))}]}}')
    text = "{" + ", ".join(members) + "}"
    json.loads(text)  # what is written can be read
    return text


SUMMARY_COLUMNS = ["total_reads", "total_bases", "total_cycles", "mean_length", "gc_bases", "gc_content", "q20_bases", "q20_rate", "q30_bases", "q30_rate", "q40_bases", "q40_rate", "cycle20_rate"]


def summary_tsv(sample: str, summary: Row, dup_rate: float, insert: Row | None = None, decimals: int = 6, comma: bool = False) -> str:
    """A header and a row: 15 columns, two more for pairs."""
    cell = lambda v: fixed(v, decimals) if isinstance(v, float) else whole(v, comma)
    names = ["sample", *SUMMARY_COLUMNS, "dup_rate"] + (["insert_size_peak", "insert_size_unknown"] if insert is not None else [])
    cells = [sample, *[cell(summary[c]) for c in SUMMARY_COLUMNS], fixed(dup_rate, decimals)] + ([whole(insert["peak"], comma), whole(insert["unknown"], comma)] if insert is not None else [])
    return "\t".join(names) + "\n" + "\t".join(cells) + "\n"


def cycles_tsv(curve: Iterable[Row]) -> str:
    names = ["mean_qual", *[f"{b}_qual" for b in "ATCG"], *[f"{b}_content" for b in CONTENTS]]
    lines = ["\t".join(["cycle", *names])]
    lines += ["\t".join([str(r["cycle"]), *[short(r[n]) for n in names]]) for r in sorted(curve, key=lambda r: r["cycle"])]
    return "\n".join(lines) + "\n"


def lengths_tsv(lengths: Iterable[Row], percent_of: int | None = None, decimals: int = 6, percent: bool = False) -> str:
    """length and count, or length and share of ``percent_of`` reads."""
    rows = sorted(lengths, key=lambda r: r["length"])
    if percent_of is None:
        return "length\tcount\n" + "".join(f"{r['length']}\t{r['n']}\n" for r in rows)
    return "length\tpercent\n" + "".join(f"{r['length']}\t{fixed((100.0 if percent else 1.0) * r['n'] / max(1, percent_of), decimals)}\n" for r in rows)


def duplication_text(duplication: Row, decimals: int = 6, percent: bool = False) -> str:
    """The duplication block of the summary."""
    rate = fixed(duplication["dup_rate"] * (100.0 if percent else 1.0), decimals) + (" %" if percent else "")
    return f"\n=== Duplication ===\n  {'Duplication rate:':<20} {rate:>12}\n"


def insert_text(peak: Row) -> str:
    """The insert-size block of a pair's summary."""
    return f"\n=== Insert Size ===\n  {'Insert size peak:':<20} {peak['peak']:>12,}\n  {'Unknown pairs:':<20} {peak['unknown']:>12,}\n"


def check_text(report: Row) -> str:
    """The validation summary for people: lines on each file, on the pair, and the totals."""
    lines = []
    for side in (report["read1"], report["read2"]):
        if side is None:
            continue
        lines.append(f"{side['path']}: reads={side['total_reads']}, bases={side['total_bases']}, errors={side['errors']}")
        if side["phred_detected"] is not None:
            lines.append(f"{side['path']}: quality={side['phred_detected']}")
        if side["platform_inferred"] is not None:
            lines.append(f"{side['path']}: platform={side['platform_inferred']} confidence={side['platform_confidence'] or 0.0:.3f} sampled_reads={side['platform_reads_sampled'] or 0}")
    return "".join(f"{x}\n" for x in lines) + f"Total reads: {report['total_reads']}\nTotal bases: {report['total_bases']}\nErrors: {report['errors']}\n"


def collected(df: DataFrame) -> list[Row]:
    """Rows of a summary table, one a cycle, length or quality value."""
    return df.collect()
