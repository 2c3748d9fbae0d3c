"""Reading what recognisers return (X20, X21) into one record form."""

from __future__ import annotations

from typing import Any

EMPTY = {"boxes": [], "texts": [], "confs": [], "avg_conf": 0.0, "word_count": 0, "error": None}


def quad(box: Any) -> list[list[int]] | None:
    """Four points as whole numbers (half to even); also of a dict's ``points``; else None."""
    if isinstance(box, dict):
        box = box.get("points")
    try:
        points = [[int(round(float(x))), int(round(float(y)))] for x, y in box]
    except (TypeError, ValueError):
        return None
    return points if len(points) == 4 else None


def text_and_confidence(item: Any) -> tuple[str, float]:
    """Of (text, conf), of a dict, or of bare text; percent becomes a fraction."""
    if isinstance(item, dict):
        text, conf = item.get("text", ""), item.get("confidence", item.get("conf", 0.0))
    elif isinstance(item, (list, tuple)):
        text, conf = (item[0] if item else ""), (item[1] if len(item) > 1 else 0.0)
    else:
        text, conf = item, 0.0
    try:
        conf = float(conf)
    except (TypeError, ValueError):
        conf = 0.0
    return str(text or ""), conf / 100 if conf > 1 else conf


def record(lines: list | None, error: str | None = None) -> dict:
    """A recogniser's lines, each (box, text and confidence), as one record; blank lines and bad boxes are dropped."""
    boxes, texts, confs = [], [], []
    for line in lines or []:
        try:
            box, rest = (line["box"], line) if isinstance(line, dict) else (line[0], line[1])
        except (KeyError, IndexError, TypeError):
            continue
        b, (text, conf) = quad(box), text_and_confidence(rest)
        if b is not None and text.strip():
            boxes.append(b)
            texts.append(text)
            confs.append(conf)
    avg = sum(confs) / len(confs) if confs else 0.0
    return EMPTY | {"boxes": boxes, "texts": texts, "confs": confs, "avg_conf": avg, "word_count": sum(bool(t.strip()) for t in texts), "error": error}
