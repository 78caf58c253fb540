"""Table schemas, configuration ids and data checks."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

DOCUMENTS = (
    "doc_id string, content string, content_type string, path string, source_url string, "
    "metadata map<string,string>, group_id string, page_number int, language string"
)
CHUNK_FIELDS = "chunk_idx int, start_offset int, end_offset int, text string, tokens int"
QUERIES = "query_id string, doc_id string, question string, answer_spans array<struct<a:int,b:int>>, reference_answer string"
TYPES = ("text", "markdown", "html", "pdf", "docx", "pptx", "code")
USE_CASES = ("rag_qa", "search", "summarization", "code_assist")


@dataclass(frozen=True)
class Config:
    """One strategy with its parameters; equal parameters give equal ids."""

    strategy: str
    params: dict[str, Any] = field(default_factory=dict, hash=False)

    @property
    def params_json(self) -> str:
        return json.dumps(self.params, sort_keys=True, separators=(",", ":"))

    @property
    def id(self) -> str:
        return f"{self.strategy}:{self.params_json}"
