"""States of a fit, committed iteration by iteration, from which a later one goes on.

An iteration's vectors are written first, under a name of their own, and then a small file that names
them and holds the scalars; a fit that is lost between the two leaves nothing that counts.  Doubles
come back as they were, so a fit that goes on is the same to the bit.
"""

from __future__ import annotations

import io
import json
import re
import uuid

import numpy as np
import pyarrow.fs as pafs

from ..sources.genomics import opened


class Commits:
    """The commits in a folder of any store that ``pyarrow.fs`` knows."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.files, self.folder = opened(self.path)
        self.files.create_dir(self.folder, recursive=True)

    def save(self, it: int, scalars: dict, vectors, arrays: dict[str, np.ndarray | None]) -> None:
        """``vectors``: those of markers, r1, x1 and x2; ``arrays``: others, of samples."""
        name = f"it-{it:06d}-{uuid.uuid4().hex}"
        vectors.save(f"{self.path}/{name}-vectors", ("r1", "x1", "x2"))
        write_arrays(f"{self.path}/{name}-arrays", {k: v for k, v in arrays.items() if v is not None})
        with self.files.open_output_stream(f"{self.folder}/{name}.part", compression=None) as f:
            f.write(json.dumps({"it": it, "name": name, "scalars": scalars}).encode())
        self.files.move(f"{self.folder}/{name}.part", f"{self.folder}/{name}.json")

    def last(self) -> dict | None:
        """``it``, ``scalars``, ``arrays`` and ``vectors`` (their path) of the last iteration that was committed."""
        found = self.files.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True))
        names = sorted(f.base_name for f in found if re.fullmatch(r"it-\d+-\w+\.json", f.base_name))
        if not names:
            return None
        with self.files.open_input_stream(f"{self.folder}/{names[-1]}", compression=None) as f:
            state = json.loads(f.read())
        base = f"{self.path}/{state['name']}"
        return state | {"vectors": f"{base}-vectors", "arrays": read_arrays(f"{base}-arrays")}


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    files, name = opened(path)
    packed = io.BytesIO()
    np.savez(packed, **arrays)
    with files.open_output_stream(name, compression=None) as f:
        f.write(packed.getvalue())


def read_arrays(path: str) -> dict[str, np.ndarray]:
    files, name = opened(path)
    with files.open_input_stream(name, compression=None) as f, np.load(io.BytesIO(f.read())) as arrays:
        return {k: arrays[k] for k in arrays.files}
