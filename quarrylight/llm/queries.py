"""Queries of the text problems (p5 to p8) and their SQL."""

from __future__ import annotations

from quarrylight.llm import garbled, packing, personal, tokens
from quarrylight.session import table


def queries() -> dict:
    t = table
    return {
        "p5_found": lambda s, d: personal.found(t(s, d, "run_entries"), t(s, d, "given_names")),
        "p5_redacted": lambda s, d: personal.replaced(t(s, d, "run_entries"), t(s, d, "given_names")),
        "p6_ids": lambda s, d: tokens.encode(t(s, d, "documents")),
        "p7_packed": lambda s, d: packing.pack_documents(t(s, d, "documents"), t(s, d, "pack_limits")),
        "p8_found": lambda s, d: garbled.affected(t(s, d, "documents")),
        "p8_restored": lambda s, d: garbled.affected(t(s, d, "documents"), restore=True),
        "p7_report": lambda s, d: packing.report(packing.pack_documents(t(s, d, "documents"), t(s, d, "pack_limits"))),
    }


def oracle_sql() -> dict[str, str]:
    return {}
