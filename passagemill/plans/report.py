"""Reports of an evaluation: JSON, text and HTML from one row of metrics."""

from __future__ import annotations

import datetime as dt
import html
import json
import os

from ..functions.text import label

LABELS = {"recall_at_1": "Recall@1", "recall_at_5": "Recall@5", "mrr_at_10": "MRR@10"}


def output_dir(requested: str | None, mode: str, model: str, now: dt.datetime | None = None) -> str:
    stamp = (now or dt.datetime.now()).strftime("%Y%m%d_%H%M%S")
    return requested or f"reports/evaluations/{stamp}_{mode}_{label(model)}"


def report(metrics: dict, settings: dict, seconds: float) -> dict:
    return {"metrics": dict(metrics), "settings": dict(settings), "environment": {"finished_at": dt.datetime.now().astimezone().isoformat(timespec="seconds"), "runtime_seconds": seconds}}


def lines(rep: dict) -> list[tuple[str, str]]:
    out = []
    for k, v in rep["metrics"].items():
        shown = f"{v:.6f} ({v:.2%})" if k in LABELS else f"{v:,}"
        out.append((LABELS.get(k, k.replace("_", " ").title()), shown))
    out += [(k.replace("_", " ").title(), str(v)) for k, v in rep["settings"].items()]
    return [*out, ("Runtime", f"{rep['environment']['runtime_seconds']:.2f} s")]


def as_text(rep: dict) -> str:
    rows = lines(rep)
    wide = max(len(k) for k, _ in rows)
    return "\n".join(["Retrieval evaluation", "=" * 20, *(f"{k:<{wide}}  {v}" for k, v in rows)]) + "\n"


def as_html(rep: dict) -> str:
    rows = "".join(f"<tr><th>{html.escape(k)}</th><td>{html.escape(v)}</td></tr>" for k, v in lines(rep))
    return f"<!doctype html><meta charset=utf-8><title>Retrieval evaluation</title><h1>Retrieval evaluation</h1><table>{rows}</table>\n"


def save(rep: dict, where: str) -> dict[str, str]:
    os.makedirs(where, exist_ok=True)
    files = {k: os.path.join(where, f"report.{e}") for k, e in (("json", "json"), ("text", "txt"), ("html", "html"))}
    rep["report_files"] = files
    for k, content in (("json", json.dumps(rep, ensure_ascii=False, indent=2) + "\n"), ("text", as_text(rep)), ("html", as_html(rep))):
        with open(files[k], "w", encoding="utf-8") as f:
            f.write(content)
    return files
