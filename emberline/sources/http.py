"""Downloads to a file on the driver."""

from __future__ import annotations

import os
import shutil
import urllib.request
from pathlib import Path

BLOCK = 64 << 10


def download(url: str, to: str | Path, timeout: int = 120, force: bool = False, opener=urllib.request.urlopen) -> dict:
    """Status (cached, ok or unavailable) of a download to ``to``.

    A file that is there stays, unless ``force``. What comes is streamed to a file beside it,
    which takes its place only when it is whole; a failure leaves what was there.
    """
    to = Path(to)
    if to.exists() and not force:
        return {"status": "cached", "path": str(to), "bytes": to.stat().st_size}
    to.parent.mkdir(parents=True, exist_ok=True)
    part = to.with_name(to.name + ".part")
    try:
        with opener(url, timeout=timeout) as source, open(part, "wb") as out:
            shutil.copyfileobj(source, out, BLOCK)
        os.replace(part, to)
    except Exception as e:  # whatever the network says is the status
        part.unlink(missing_ok=True)
        return {"status": "unavailable", "path": None, "error": f"{type(e).__name__}: {e}"}
    return {"status": "ok", "path": str(to), "bytes": to.stat().st_size}
