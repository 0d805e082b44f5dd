"""Column types of the tables that the operators take and give, as DDL; readers and createDataFrame take them as they are."""

from __future__ import annotations

_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"

PAGES = "page_id bigint, url string, html string"
LINKS = "page_id bigint, pos bigint, url string, text string, is_internal boolean"
PAGE_INFO = "page_id bigint, url string, title string, description string, status_code int, content_type string, content_length bigint, last_modified string, error string"
PAGE_MARKDOWN = "page_id bigint, url string, title string, markdown string, word_count bigint, success boolean, error string"
WEB_TABLES = "page_id bigint, markdown string, rows int, columns int, headers array<string>, caption string, cells array<array<string>>"
WEB_IMAGES = "page_id bigint, src string, alt string, title string, width int, height int"
WEB_CODE = "page_id bigint, code string, language string"
WEB_FORMULAS = "page_id bigint, latex string, formula_type string, source_format string"
TEXT_BLOCKS = f"doc_id bigint, page int, block_no int, bbox {_BOX}, text string, block_type string, heading_level int, reading_order bigint, confidence double"
LAYOUT_REGIONS = f"doc_id bigint, page int, region_type string, bbox {_BOX}, reading_order bigint, confidence double"
DOC_TABLES = f"doc_id bigint, table_id string, page int, bbox {_BOX}, markdown string, rows bigint, columns bigint, headers array<string>, caption string, confidence double, reading_order bigint"
DOC_FORMULAS = f"doc_id bigint, formula_id string, page int, bbox {_BOX}, latex string, formula_type string, original_text string, confidence double, reading_order bigint"
DOC_IMAGES = f"doc_id bigint, image_id string, page int, bbox {_BOX}, filename string, base64_data string, mime_type string, width int, height int, caption string, reading_order bigint"
DOC_CODE = f"doc_id bigint, code_id string, page int, bbox {_BOX}, code string, language string, is_algorithm boolean, confidence double, reading_order bigint"
CANDIDATES = "doc_id bigint, engine string, rank int, success boolean, content string"
