"""Release archive: metadata as YAML, text companions as they are, everything else zipped."""

from __future__ import annotations

import os
import shutil
import zipfile
from collections.abc import Mapping


def yaml_value(value: str) -> str:
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def format_duration(seconds: int) -> str:
    h, rest = divmod(max(0, int(seconds)), 3600)
    m, s = divmod(rest, 60)
    return f"{h}h {m:02d}m {s:02d}s" if h else f"{m}m {s:02d}s" if m else f"{s}s"


def archive(files: list[str], info: Mapping[str, str], folder: str, name: str) -> str:
    """Write ``name``.zip, ``dump-info.yaml`` and copies of the .txt files to ``folder``; an existing zip is an error."""
    os.makedirs(folder, exist_ok=True)
    out = os.path.join(folder, name + ".zip")
    with open(os.path.join(folder, "dump-info.yaml"), "w", encoding="utf-8") as f:
        f.writelines(f"{k}: {yaml_value(v)}\n" for k, v in info.items())
    with zipfile.ZipFile(out, "x", zipfile.ZIP_DEFLATED) as z:
        for path in files:
            if path.endswith(".txt"):
                shutil.copy(path, folder)
            else:
                z.write(path, os.path.basename(path))
    return out
