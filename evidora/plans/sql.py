"""SQL fragments shared by the oracles."""

from __future__ import annotations

from evidora import config as C


def words(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in sorted(set(items))) + "]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def content(text: str) -> str:
    return f"list_filter({tokens(text)}, lambda x: length(x) > 1 AND NOT list_contains({words(C.STOPWORDS)}, x))"


def sentences(text: str) -> str:
    """Look-behind isn't available: a mark is put after the full stop and cut at."""
    return f"list_filter(list_transform(string_split(regexp_replace(trim({text}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


def coverage(q: str, t: str) -> str:
    return f"CASE WHEN len({q}) = 0 THEN 0.0 ELSE len(list_intersect({q}, {t})) / len({q}) END"


def density(text: str, own: str) -> str:
    return (
        f"CASE WHEN len({own}) = 0 THEN 0.0 ELSE least(1.0, (len(regexp_extract_all({text}, '{C.NUMBER}')) + "
        f"len(list_filter({own}, lambda x: list_contains({words(C.MODALS)}, x)))) / greatest(len({own}) / 8, 1.0)) END"
    )


def normal_answer(text: str) -> str:
    """Word by word, as \\b knows ASCII letters only."""
    bare = f"translate(lower({text}), {quoted(C.PUNCTUATION)}, '')"
    return f"array_to_string(list_filter(regexp_split_to_array({bare}, '\\s+'), lambda z: z NOT IN ('', 'a', 'an', 'the')), ' ')"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table of literals."""
    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return quoted(v)
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(one, v)) + "]"
        return str(v).lower() if isinstance(v, bool) else str(v)

    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)})"
