"""The records of the engine."""

from __future__ import annotations

DOCUMENT = "doc_id string, content binary, extension string, mimetype string, charset string, filename string, local_path string, url string"
ERRORS = "array<struct<converter: string, message: string>>"
RESULT = f"doc_id string, converter string, markdown string, title string, errors {ERRORS}"
#: Columns of a document that describe its content.
INFO = ("extension", "mimetype", "charset", "filename", "local_path", "url")
FETCHED = "doc_id string, url string, status int, content_type string, content binary, error string"
TEXT_BOXES = "doc_id string, page_number int, seq int, id string, text string, x_left double, x_right double, y_top double, y_bottom double, font_size double, is_bold boolean"
SEGMENTS = "doc_id string, page_number int, seq int, x1 double, y1 double, x2 double, y2 double"
IMAGES = "doc_id string, page_number int, id string, x_left double, y_bottom double, x_right double, y_top double"
PAGES = "doc_id string, page_number int, page_width double, page_height double"
