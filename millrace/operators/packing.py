"""Packing of evidence within a budget of characters: targets first, then by rank, each candidate cropped around its
child to the most that fits."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame

#: Characters of a pack and of an item's content; items of a document, and where all candidates are of one.
BUDGET, CROP, PER_DOCUMENT, PER_SINGLE = 12_000, 1_200, 3, 6
ELLIPSIS, BLANK = "…", "… \n\r\t"


def crop(content: str, child: str, limit: int) -> str:
    """At most `limit` characters of content, half of them before where the child begins (the middle, if it isn't
    found); a cut end costs one for its ellipsis. A larger limit's crop holds a smaller one's."""
    n = len(content)
    if n <= limit:
        return content
    at = content.find(child) if child else -1
    start = max(0, min((n // 2 if at < 0 else at) - limit // 2, n - limit))
    room = max(0, limit - (start > 0) - (start + limit < n))
    if limit < 1:
        return ""
    if start + limit < n:
        return (ELLIPSIS if start else "") + content[start : start + room] + ELLIPSIS
    return ELLIPSIS + content[n - room :]


def envelope(document: str, evidence: str, content: str, headings: Sequence[str]) -> str:
    """Content marked as data that isn't to be trusted, as compact JSON."""
    out = {"trust": "untrusted_data", "source": f"document:{document}", "evidence_id": evidence, "content": content}
    return json.dumps(out | ({"heading_path": list(headings)} if len(headings) else {}), ensure_ascii=False, separators=(",", ":"))


def longest(content: str, render: Callable[[int], str], room: int) -> int | None:
    """The largest limit whose rendering fits room, by halving (renderings grow with their limit); None if none does."""
    if len(render(len(content))) <= room:
        return len(content)
    low, high = -1, len(content)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if len(render(middle)) <= room else (low, middle)
    return low if low >= 0 else None


def pack(candidates: Sequence[dict], targets: Sequence[str], budget: int) -> list[tuple[int, str, str]]:
    """(place among the candidates, content, rendering) of those accepted, in order. Candidates come by rank, with
    document, evidence, content, child, headings and targets."""
    single = len({c["document"] for c in candidates}) == 1
    cap = PER_SINGLE if single else PER_DOCUMENT
    per, chosen, covered, out, used = Counter(), set(), set(), [], 0

    def taken(i: int) -> bool:
        nonlocal used
        c = candidates[i]
        if i in chosen or per[c["document"]] >= cap:
            return False
        whole = crop(c["content"], c["child"], CROP)
        room = budget - used - bool(out)
        render = lambda n: envelope(c["document"], c["evidence"], crop(whole, c["child"], n), c["headings"])
        limit = longest(whole, render, room)
        content = "" if limit is None else crop(whole, c["child"], limit)
        if not content.strip(BLANK):
            return False
        out.append((i, content, render(limit)))
        used += len(out[-1][2]) + (len(out) > 1)
        chosen.add(i)
        per[c["document"]] += 1
        covered.update(c["targets"])
        return True

    for t in targets:
        if t not in covered:
            any(t in c["targets"] and taken(i) for i, c in enumerate(candidates))
    for i in range(len(candidates)):
        taken(i)
    return out


def packed(candidates: DataFrame, request: str, targets: Sequence[str], budget: int = BUDGET) -> DataFrame:
    """candidates(request, rank, document, evidence, content, child, headings, targets) to (request, evidence, position,
    content, rendered), request by request. A request has no more candidates than its rerank limit, so a group is small;
    a candidate that doesn't fit at all is passed over. Null texts are empty and so never accepted."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "evidence"]).reset_index(drop=True)
        rows = [{k: list(v) if k in ("headings", "targets") and v is not None else v if v is not None else [] if k in ("headings", "targets") else "" for k, v in r.items()} for r in pdf.drop(columns=[request]).to_dict("records")]
        out = [(pdf[request].iloc[0], rows[i]["evidence"], n, content, text) for n, (i, content, text) in enumerate(pack(rows, targets, budget), 1)]
        return pd.DataFrame(out, columns=[request, "evidence", "position", "content", "rendered"])

    return candidates.groupBy(request).applyInPandas(run, f"{request} {dict(candidates.dtypes)[request]}, evidence string, position int, content string, rendered string")
