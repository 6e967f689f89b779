"""Listing and writing of files by tasks, on any file system that Arrow knows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

ENTRY = "path string, name string, length long, is_folder boolean"


def place(url: str):  # noqa: ANN201 - a file system and a path
    """The file system of an address and the path there.  As in Spark, nothing in an address is escaped; a bare path is local."""
    from pyarrow import fs

    scheme, colon, rest = url.partition(":/")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if colon else url
    host, _, path = rest.lstrip("/").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return system, f"{base.rstrip('/')}/{path}"


def entries(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each folder (path) holds, itself left out."""
    from pyarrow import fs

    for pdf in pdfs:
        for url in pdf.path:
            system, path = place(url)
            base = url.rstrip("/")
            found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
            for at in range(0, len(found), 10_000):
                some = found[at : at + 10_000]
                yield pd.DataFrame({
                    "path": [f"{base}/{i.base_name}" for i in some], "name": [i.base_name for i in some],
                    "length": [i.size or 0 for i in some], "is_folder": [i.type == fs.FileType.Directory for i in some],
                })


def write_bytes(url: str, data: bytes) -> None:
    """A file, with the folder that it is in; a file that is there is replaced."""
    system, path = place(url)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)
