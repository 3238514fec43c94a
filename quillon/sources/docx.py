"""DOCX packages rewritten in place: replacements of ranges of the visible text go into the runs that hold them, and what the
package shows afterwards is compared with what it must show. Packages go to Python in Arrow batches, one at a time.

The visible text of a package is that of its units (see files.docx_units), joined by line breaks.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .files import W, docx_units, story_of

RESULT = "struct<content:binary,done:int,failed:array<string>,text:string>"


def shares(size: int, lengths: list[int]) -> list[int]:
    """size cut in proportion to lengths, by largest remainders (of equals the first)."""
    total = sum(lengths)
    out = [size * n // total for n in lengths]
    for i in sorted(range(len(lengths)), key=lambda i: (-(size * lengths[i] % total), i))[: size - sum(out)]:
        out[i] += 1
    return out


def _pieces(paragraph: ElementTree.Element) -> list[tuple[ElementTree.Element | None, str]]:
    """What a paragraph shows, in order: runs of text, and marks that can't be rewritten (None)."""
    out: list[tuple[ElementTree.Element | None, str]] = []
    for x in paragraph.iter():
        if x.tag == f"{W}t":
            out.append((x, x.text or ""))
        elif x.tag == f"{W}tab":
            out.append((None, "\t"))
        elif x.tag in (f"{W}br", f"{W}cr"):
            out.append((None, "\n"))
    return out


def _replace(paragraph: ElementTree.Element, start: int, end: int, new: str) -> bool:
    """Put new for [start, end) of a paragraph's text, cut over the runs that the range touches; False if a mark is in it."""
    at, touched = 0, []
    for node, text in _pieces(paragraph):
        a, b = max(start, at), min(end, at + len(text))
        if a < b:
            if node is None:
                return False
            touched.append((node, a - at, b - at))
        at += len(text)
    cut = 0
    for (node, a, b), n in zip(touched, shares(len(new), [b - a for _, a, b in touched]), strict=True):
        text = node.text or ""
        node.text = text[:a] + new[cut : cut + n] + text[b:]
        if node.text != node.text.strip():
            node.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
        cut += n
    return bool(touched)


def visible_text(content: bytes) -> str:
    return "\n".join(u["text"] for u in docx_units("", content))


def rewrite_package(content: bytes, edits: list[tuple[int, int, str, str]]) -> tuple[bytes, int, list[str], str]:
    """The package with edits (start, end, source, replacement) of its visible text made, how many were, what failed and why, and
    the text it shows. An edit must lie in one paragraph, its source must stand there, and edits must not overlap (the
    first in order stays). If the package then doesn't show the text that the edits make, it stays as it was."""
    try:
        before = visible_text(content)
    except (zipfile.BadZipFile, ElementTree.ParseError):
        return content, 0, ["damaged_package"], ""
    failed, good, last = [], [], 0
    for start, end, source, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        reason = "invalid_range" if start < 0 or end <= start else "source_range_mismatch" if before[start:end] != source else "range_overlap" if start < last else "not_in_one_unit" if "\n" in source else ""
        if reason:
            failed.append(f"{start}:{reason}")
        else:
            good.append((start, end, new))
            last = end
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        parts = {n: package.read(n) for n in package.namelist()}
        infos = package.infolist()
    roots, place, spots = {}, 0, []
    for name in sorted(parts, key=lambda n: (n != "word/document.xml", n)):
        if story_of(name, parts[name]) is None:
            continue
        for prefix, uri in (pair for _, pair in ElementTree.iterparse(io.BytesIO(parts[name]), events=["start-ns"])):  # noqa: S314
            ElementTree.register_namespace(prefix, uri)
        roots[name] = ElementTree.fromstring(parts[name])  # noqa: S314
        for p in roots[name].iter(f"{W}p"):
            text = "".join(t for _, t in _pieces(p))
            if text.strip():
                spots.append((place, place + len(text), p, name))
                place += len(text) + 1
    want, done, changed = before, 0, set()
    for start, end, new in reversed(good):  # from the right, so that places before stay
        own = next(((a, p, name) for a, b, p, name in spots if a <= start and end <= b), None)
        if own and _replace(own[1], start - own[0], end - own[0], new):
            want, done = want[:start] + new + want[end:], done + 1
            changed.add(own[2])
        else:
            failed.append(f"{start}:unrewritable")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for info in infos:
            data = ElementTree.tostring(roots[info.filename], encoding="UTF-8", xml_declaration=True) if info.filename in changed else parts[info.filename]
            package.writestr(info, data)
    shown = visible_text(out.getvalue())
    if shown != want:
        return content, 0, [*sorted(failed), "text_differs"], before
    return out.getvalue(), done, sorted(failed), shown


def rewritten(content: Column, edits: Column) -> Column:
    """struct<content, done, failed, text> of packages with edits (array<struct<start,end,source,replacement>>) made."""

    @F.pandas_udf(RESULT)
    def run(packages: pd.Series, lists: pd.Series) -> pd.DataFrame:
        rows = [rewrite_package(bytes(c), [(e["start"], e["end"], e["source"], e["replacement"]) for e in own] if own is not None else []) for c, own in zip(packages, lists, strict=True)]
        return pd.DataFrame(rows, columns=["content", "done", "failed", "text"])

    return run(content, edits)


def replaced_strings(content: Column, pairs: list[tuple[str, str]]) -> Column:
    """Packages with strings replaced wherever they stand, longer ones first and none in what was put in: the way for sources whose
    ranges aren't known."""
    ordered = sorted({a: b for a, b in pairs if a}.items(), key=lambda x: (-len(x[0]), x[0]))

    def edits(text: str) -> list[tuple[int, int, str, str]]:
        taken: list[tuple[int, int, str, str]] = []
        for old, new in ordered:
            at = text.find(old)
            while at >= 0:
                if all(at >= e or at + len(old) <= s for s, e, _, _ in taken):
                    taken.append((at, at + len(old), old, new))
                at = text.find(old, at + len(old))
        return taken

    return _each(lambda c: rewrite_package(c, edits(visible_text(c))), content)


def _each(rule: Callable[[bytes], tuple], content: Column) -> Column:
    @F.pandas_udf(RESULT)
    def run(packages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rule(bytes(c)) for c in packages], columns=["content", "done", "failed", "text"])

    return run(content)


def coverage(content: Column) -> Column:
    """array<struct<part, visible, covered>>: for each part that shows text how many characters it shows, and how many of them
    units hold; text outside paragraphs is what units miss."""

    def parts(data: bytes) -> list[dict]:
        try:
            held: dict[str, int] = {}
            for u in docx_units("", data):
                held[u["part_name"]] = held.get(u["part_name"], 0) + len("".join(u["text"].split()))
            out = []
            with zipfile.ZipFile(io.BytesIO(data)) as package:
                for name in sorted(package.namelist()):
                    if name.startswith("word/") and name.endswith(".xml"):
                        shown = "".join(x.text or "" for x in ElementTree.fromstring(package.read(name)).iter(f"{W}t"))  # noqa: S314
                        if n := len("".join(shown.split())):
                            out.append({"part": name, "visible": n, "covered": held.get(name, 0)})
            return out
        except (zipfile.BadZipFile, ElementTree.ParseError):
            return []

    @F.pandas_udf("array<struct<part:string,visible:int,covered:int>>")
    def run(packages: pd.Series) -> pd.Series:
        return pd.Series([parts(bytes(c)) for c in packages])

    return run(content)
