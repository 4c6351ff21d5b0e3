"""Edits of a BibTeX file's text that leave everything else in it as it is. One file is one text; this
is work for the driver, not for a plan."""

from __future__ import annotations

from folioscope.sources.markup import bib_entries


def keys(text: str) -> list[str]:
    return [key for _, key, *_ in bib_entries(text)]


def renamed(entry: str, key: str) -> str:
    """the entry under another key; what is no entry stays as it is."""
    brace = entry.find("{")
    ends = [at for at in (entry.find(",", brace), entry.find("\n", brace)) if at > brace]
    return entry[: brace + 1] + key + entry[min(ends) :] if brace >= 0 and ends else entry


def append(text: str, entry: str) -> str:
    """A blank line lies between entries."""
    return (text.rstrip("\n") + "\n\n" if text.strip() else "") + entry.strip("\n") + "\n"


def upsert(text: str, entry: str) -> str:
    """An entry of the same key is replaced where it is; any other is appended."""
    new = next(iter(bib_entries(entry)), None)
    if new is not None:
        for _, key, _, _, start, end in bib_entries(text):
            if key == new[1]:
                return text[:start] + entry.strip("\n") + text[end:]
    return append(text, entry)


def without(text: str, gone: set[str]) -> str:
    """K8, K9: all entries with these keys go, with the line end after them; all other text stays."""
    out, at = [], 0
    for _, key, _, _, start, end in bib_entries(text):
        if key in gone:
            out.append(text[at:start])
            at = end + text.startswith("\n", end)
    return "".join([*out, text[at:]])


def rewrite(path: str, edit) -> None:
    """Reads, edits and replaces a file, whole or not at all."""
    import os
    import tempfile

    with open(path, encoding="utf-8") as f:
        text = f.read()
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(edit(text))
    os.replace(temporary, path)
