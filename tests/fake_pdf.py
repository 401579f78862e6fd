"""A stand-in for the PDF library: a file is a header and JSON, {"pages": [{"words": [...], "fault": ...}]}."""

import json
from types import SimpleNamespace


class Page:
    def __init__(self, given):
        self.given, self.rect = given, SimpleNamespace(width=500.0, height=400.0, get_area=lambda: 200_000.0)

    def get_text(self, kind, sort):
        if self.given.get("fault"):
            raise RuntimeError(self.given["fault"])
        return [(10.0 * i, 0.0, 10.0 * i + 8, 10.0, w, 0, 0, i) for i, w in enumerate(self.given["words"])]

    def get_image_info(self):
        return []


class Document:
    is_pdf, needs_pass = True, False

    def __init__(self, data):
        self.pages = [Page(p) for p in json.loads(data[5:])["pages"]]
        self.page_count = len(self.pages)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def __iter__(self):
        return iter(self.pages)

    def load_page(self, i):
        return self.pages[i]


def library():
    return SimpleNamespace(open=lambda stream, filetype: Document(bytes(stream)))
