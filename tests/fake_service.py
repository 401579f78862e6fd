"""A feature service in a folder, for tests in which tasks and attempts of them use one service. Options: folder, and perhaps ``fail`` and ``once`` (a place that ends the process or raises, once)."""

import json
import os
import uuid
from pathlib import Path
from types import SimpleNamespace

from planmatch.errors import ServiceError
from planmatch.operators.permits import POLE_FIELDS, WORK_AREA_FIELDS


class Layer:
    def __init__(self, folder, name, fields, options):
        self.folder, self.name, self.fields, self.options = Path(folder) / name, name, [f.upper() for f in fields], options
        self.folder.mkdir(parents=True, exist_ok=True)

    def trip(self, place):
        mark = Path(self.options["folder"]) / f"tripped-{place}"
        if self.options.get("once") == place and not mark.exists():
            mark.touch()
            if self.options.get("kill"):
                os._exit(1)
            raise ConnectionError("the line went dead")

    def add(self, features):
        self.trip(f"before-{self.name}")
        out = []
        for f in features:
            values = f["attributes"]
            if values.get("POLE_ID") == self.options.get("refuse", "-"):
                out.append({"success": False, "error": "full"})
                continue
            ids = {"objectId": len(list(self.folder.glob("*.json"))) + 1, "globalId": "{" + uuid.uuid4().hex + "}"}
            (self.folder / f"{uuid.uuid4().hex}.json").write_text(json.dumps(f | ids))
            out.append({"success": True, **ids})
        self.trip(f"after-{self.name}")
        return out

    def all(self):
        return [json.loads(p.read_text()) for p in self.folder.glob("*.json")]

    def find(self, field, value):
        return [f for f in self.all() if f["attributes"].get(field) == value]

    def attach(self, object_id, content):
        (self.folder / f"{object_id}-{uuid.uuid4().hex}.pdf").write_bytes(content)
        self.trip("after-file")
        return True

    def attached(self, object_id):
        return bool(list(self.folder.glob(f"{object_id}-*.pdf")))


def session(options):
    if options.get("down"):
        raise ServiceError("nobody is there")
    areas, poles = Layer(options["folder"], "permits", WORK_AREA_FIELDS, options), Layer(options["folder"], "poles", POLE_FIELDS, options)
    return SimpleNamespace(user="u", item=lambda _: SimpleNamespace(layers=[areas, poles]))
