"""Rules for the keys and values of documents, and walks over parsed documents."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterable

from ..tables import FILE_EXTENSIONS, NON_CONTENT_KEYS, NON_CONTENT_SUFFIXES, NOT_RENDERED_KEYS, URL_PREFIXES
from . import findings
from .fixing import fix
from .mend import repair
from .write import canonicalize


def is_non_content_key(key) -> bool:
    if not isinstance(key, str):
        return False
    k = key.lower().replace("-", "_")
    return k in NON_CONTENT_KEYS or k.replace("_", "") in NON_CONTENT_KEYS or k.endswith(NON_CONTENT_SUFFIXES)


def is_not_rendered_key(key) -> bool:
    return isinstance(key, str) and (key.lower() in NOT_RENDERED_KEYS or key.lower().endswith("_raw") or key.lower().startswith("raw_"))


def is_url_or_path(text) -> bool:
    return isinstance(text, str) and (text.startswith(URL_PREFIXES) or text.lower().endswith(FILE_EXTENSIONS))


def is_narrative_key(key, siblings: Iterable, narrative: Iterable[str]) -> bool:
    """An entry ``name@sibling`` holds only beside that sibling."""
    entries = (e.partition("@") for e in narrative)
    return any(key == name and (not sibling or sibling in siblings) for name, _, sibling in entries)


def rewrite(node, f: Callable[[str], str], key: str = "", narrative: tuple = (), dates: bool = False):
    """A parsed document with ``f`` over its content strings; items of a list have the key of the list."""
    if isinstance(node, str):
        return node if is_non_content_key(key) or is_url_or_path(node) else f(node)
    if isinstance(node, dict):
        return {k: repair_deep(v) if is_narrative_key(k, node, narrative) else rewrite(v, f, k, narrative, dates) for k, v in node.items()}
    if isinstance(node, list):
        return [rewrite(v, f, key, narrative, dates) for v in node]
    if dates and isinstance(node, datetime.datetime):
        return (node if node.tzinfo else node.replace(tzinfo=datetime.UTC)).isoformat()
    return node.isoformat() if dates and isinstance(node, datetime.date) else node


def repair_deep(node):
    """``repair`` over every string, whatever its key."""
    if isinstance(node, str):
        return repair(node)
    if isinstance(node, dict):
        return {k: repair_deep(v) for k, v in node.items()}
    return [repair_deep(v) for v in node] if isinstance(node, list) else node


def fix_deep(node, chemistry: bool = True, narrative: tuple = ()):
    return rewrite(node, lambda t: fix(t, chemistry), narrative=narrative)


def canonicalize_deep(node, chemistry: bool = True, narrative: tuple = ()):
    return rewrite(node, lambda t: canonicalize(t, chemistry), narrative=narrative, dates=True)


def content_leaves(node, key: str = "", path: str = ""):
    """(path, text) of the strings that are rendered; strings that are JSON documents are read as such."""
    if isinstance(node, str):
        if is_non_content_key(key) or is_not_rendered_key(key) or is_url_or_path(node):
            return
        inner = None
        if node.lstrip()[:1] in ("{", "["):
            try:
                inner = json.loads(node)
            except ValueError:
                inner = None
        if isinstance(inner, (dict, list)):
            yield from content_leaves(inner, key, f"{path}(json)")
        else:
            yield path, node
    elif isinstance(node, dict):
        for k, v in node.items():
            yield from content_leaves(v, str(k), f"{path}.{k}" if path else str(k))
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from content_leaves(v, key, f"{path}[{i}]")


def audit_deep(node) -> list[tuple[str, findings.Finding]]:
    return [(path, f) for path, text in content_leaves(node) for f in findings.audit(text)]
