"""Results of a run by case: JSON with a Markdown summary beside it, replaced as a whole, resumed by fingerprint."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from dataclasses import asdict
from pathlib import Path

from tarnspark.operators.cases import ReferenceCase
from tarnspark.operators.verdict import CaseVerdict


def fingerprint(case: ReferenceCase) -> str:
    """Changes with anything that changes the case's result."""
    code = case.build.__code__
    parts = (case.case_id, case.columns, case.key, case.limit, case.window_years, case.max_rows, code.co_code.hex(), repr([c for c in code.co_consts if not hasattr(c, "co_code")]))
    return hashlib.sha256(repr(parts).encode()).hexdigest()


def _replace(path: Path, text: str) -> None:
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=path.name)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, path)


class ResultStore:
    """One record a case. With ``resume``, an existing file is taken up if it was made under the same settings."""

    def __init__(self, path: str | Path, settings: dict, resume: bool = False):
        self.path, self.settings, self.records = Path(path), settings, {}
        if resume and self.path.exists():
            old = json.loads(self.path.read_text(encoding="utf-8"))
            if old["settings"] != settings:
                raise ValueError("the file was made under other settings")
            self.records = old["records"]

    def is_final(self, case: ReferenceCase) -> bool:
        """Evaluated before, as the case is now: errors are run again."""
        r = self.records.get(case.case_id)
        return bool(r) and r["fingerprint"] == fingerprint(case) and r["verdict"] in ("pass", "fail")

    def put(self, case: ReferenceCase, verdict: CaseVerdict, **more) -> None:
        self.records[case.case_id] = {"fingerprint": fingerprint(case)} | asdict(verdict) | more
        _replace(self.path, json.dumps({"settings": self.settings, "records": self.records}, ensure_ascii=False, indent=1, default=str))
        rows = "".join(f"| {k} | {r['verdict']} | {r['category'] or ''} | {r['message']} |\n" for k, r in sorted(self.records.items()))
        _replace(self.path.with_suffix(".md"), "| case | verdict | why | message |\n|---|---|---|---|\n" + rows)
