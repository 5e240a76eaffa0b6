"""The queries of this subpackage, by name, and SQL where SQL can express one."""

from __future__ import annotations

from weftline.llm.cross_split import p1_found, p1_report
from weftline.llm.history import p3_found
from weftline.llm.leaks import p2_cleaned, p2_found
from weftline.llm.mixing import p7_documents, p7_mixed, p7_shares
from weftline.llm.packing import p6_fill, p6_packed
from weftline.llm.pairs import p5_found
from weftline.llm.scans import p4_found, p4_text
from weftline.llm.spans import p8_found, p8_shared, p8_spans

QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_cleaned": p2_cleaned,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_text": p4_text,
    "p5_found": p5_found,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p7_documents": p7_documents,
    "p7_shares": p7_shares,
    "p7_mixed": p7_mixed,
    "p8_found": p8_found,
    "p8_shared": p8_shared,
    "p8_spans": p8_spans,
}

SQL: dict[str, str] = {}
