"""The configured catalogue of categories, brands and models: normalise, edit, sheet form."""

from __future__ import annotations

import copy
import json
import re

from .model_matcher import model_pattern

# The sheet's columns.
SHEET = ["Категорія", "Теги категорії", "Бренд", "Теги бренду", "Модель", "Теги моделі", "Патерн"]


def split_tags(text: str | None) -> list[str]:
    seen: dict[str, str] = {}
    for t in re.split(r"[\n,;]", text or ""):
        if t.strip():
            seen.setdefault(t.strip().lower(), t.strip())
    return list(seen.values())


def _unique(tags: list[str]) -> list[str]:
    return split_tags("\n".join(str(t) for t in tags))


def _named(items) -> list[dict]:
    rows = [x for x in items or [] if isinstance(x, dict) and str(x.get("name") or "").strip()]
    return sorted(rows, key=lambda x: str(x["name"]).strip().lower())


def normalised(data: dict) -> dict:
    """Unnamed entries out, names trimmed and sorted, a model's tags led by category, brand and model, patterns filled in."""
    out = []
    for c in _named(data.get("categories")):
        cat = {"name": str(c["name"]).strip(), "tags": _unique(c.get("tags") or [c["name"]]), "brands": []}
        for b in _named(c.get("brands")):
            brand = {"name": str(b["name"]).strip(), "tags": _unique(b.get("tags") or [b["name"]]), "models": []}
            for m in _named(b.get("models")):
                name = str(m["name"]).strip()
                brand["models"].append({"name": name, "pattern": m.get("pattern") or model_pattern(brand["name"], name), "tags": _unique([cat["name"], brand["name"], name, *(m.get("tags") or [])])})
            cat["brands"].append(brand)
        out.append(cat)
    return {"categories": out}


def records(data: dict) -> list[dict]:
    """The flat models: category, brand, name, pattern, tags."""
    return [{"category": c["name"], "brand": b["name"], **m} for c in normalised(data)["categories"] for b in c["brands"] for m in b["models"]]


def load(text: str | None, default: dict | None = None) -> dict:
    """The catalogue of a JSON text; a missing or broken one gives the default."""
    try:
        data = json.loads(text or "")
        return normalised(data if isinstance(data, dict) else default or {})
    except ValueError:
        return normalised(default or {})


def names(data: dict, *path: str) -> list[str]:
    """The categories, the brands of a category, or the models of a category's brand; none if the path isn't there."""
    items = normalised(data)["categories"]
    for step, name in zip(("brands", "models"), path):
        here = _find(items, name)
        items = here[step] if here else []
    return [x["name"] for x in items]


def _find(items: list[dict], name: str) -> dict | None:
    return next((x for x in items if x["name"].lower() == name.strip().lower()), None)


def edit(data: dict, path: list[str], new: str | None) -> dict:
    """A copy with the entry at path (category, brand, model) added, renamed or deleted.

    path ends with the entry's present name, or with "" to add `new`; new None deletes. Names are unique among
    their neighbours whatever their case. A rename goes into the tags of all models below and their default
    patterns are made anew.
    """
    data = normalised(copy.deepcopy(data))
    level, items, box = len(path), data["categories"], ["brands", "models"]
    above: list[dict] = []
    for i, name in enumerate(path[:-1]):
        x = _find(items, name)
        if x is None:
            raise KeyError(name)
        above.append(x)
        items = x[box[i]]
    old = path[-1].strip()
    if new is not None and not new.strip():
        raise ValueError("a name is needed")
    taken = _find(items, new) if new is not None else None
    here = _find(items, old) if old else None
    if taken is not None and taken is not here:
        raise ValueError(f"{new} exists")
    if old and here is None:
        raise KeyError(old)
    if not old:
        items.append({"name": new.strip(), **({box[level - 1]: []} if level < 3 else {})})
    elif new is None:
        items.remove(here)
    else:
        swap = lambda tags: [new.strip() if t.lower() == here["name"].lower() else t for t in tags]
        below = [here] if level == 3 else here["models"] if level == 2 else [m for b in here["brands"] for m in b["models"]]
        for m in below:
            m["tags"] = swap(m["tags"])
            if level > 1:
                m["pattern"] = None
        here["tags"] = swap(here["tags"])
        here["name"] = new.strip()
    return normalised(data)


def to_sheet(data: dict) -> list[list[str]]:
    """Rows of the sheet form, below SHEET."""
    out = []
    for c in normalised(data)["categories"]:
        for b in c["brands"]:
            out += [[c["name"], ", ".join(c["tags"]), b["name"], ", ".join(b["tags"]), m["name"], ", ".join(m["tags"]), m["pattern"]] for m in b["models"]]
    return out


def from_sheet(headers: list[str], rows: list[list[str | None]]) -> dict:
    """The catalogue of sheet rows; wrong headers, incomplete rows and models listed twice raise ValueError with row numbers."""
    if [str(h or "").strip() for h in headers[: len(SHEET)]] != SHEET:
        raise ValueError("headers must be " + ", ".join(SHEET))
    clean = [[str(v or "").strip() for v in (r + [None] * 7)[:7]] for r in rows]
    if bad := [i for i, r in enumerate(clean, 2) if any(r) and not (r[0] and r[2] and r[4])]:
        raise ValueError(f"rows without category, brand or model: {', '.join(map(str, bad))}")
    places: dict[tuple, list[int]] = {}
    for i, r in enumerate(clean, 2):
        if any(r):
            places.setdefault((r[0].lower(), r[2].lower(), r[4].lower()), []).append(i)
    clean = [r for r in clean if any(r)]
    if twice := [f"{' / '.join(k)} (рядки {', '.join(map(str, at))})" for k, at in places.items() if len(at) > 1]:
        raise ValueError("дублюється: " + "; ".join(twice))
    tree: dict = {}
    for cat, cat_tags, brand, brand_tags, model, tags, pattern in clean:
        c = tree.setdefault(cat.lower(), {"name": cat, "tags": split_tags(cat_tags), "brands": {}})
        b = c["brands"].setdefault(brand.lower(), {"name": brand, "tags": split_tags(brand_tags), "models": []})
        b["models"].append({"name": model, "tags": split_tags(tags), "pattern": pattern or None})
    return normalised({"categories": [{**c, "brands": list(c["brands"].values())} for c in tree.values()]})


_FORMULA = re.compile(r"""REGEXMATCH\s*\(\s*\{\{\s*name\s*\}\}\s*[,;]\s*("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')\s*\)""", re.I)


def conditions_of(formula: str | None) -> list[str]:
    """The patterns of a sheet formula =IF(AND(REGEXMATCH({{name}},"…"), …)), in either kind of quotes.

    A backslash escapes a quote or a backslash; before any other character it stays. Empty patterns go.
    """
    return [c for m in _FORMULA.findall(formula or "") if (c := re.sub(r"""\\([\\"'])""", r"\1", m[1:-1]))]


def formula_of(conditions: list[str]) -> str:
    if not conditions:
        return ""
    quoted = ('"' + re.sub(r'([\\"])', r"\\\1", c) + '"' for c in conditions)
    return "=IF(AND(" + ", ".join(f"REGEXMATCH({{{{name}}}},{q})" for q in quoted) + "))"
