"""Text of scanned pages by optional packages: pages are drawn and read in Arrow batches of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from marginalia.sources.files import extraction_state

#: Pages of a document as texts: (content, dots per inch, most pages) -> texts.
Reader = Callable[[bytes, int, int], list[str]]


def read_pages(content: bytes, dpi: int, most: int) -> list[str]:
    """Pages drawn by pypdfium2 and read by pytesseract, where both are installed."""
    try:
        import pypdfium2
        import pytesseract
    except ImportError as e:
        raise RuntimeError("pypdfium2 and pytesseract are not installed") from e
    document = pypdfium2.PdfDocument(content)
    return [pytesseract.image_to_string(document[k].render(scale=dpi / 72).to_pil()) for k in range(min(most, len(document)))]


def recognised(files: DataFrame, reader: Reader = read_pages, dpi: int = 220, most: int = 80) -> DataFrame:
    """(path, status, text, pages, error) of ``files(path, content)``; a file that can't be read is a row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame.path, frame.content):
                try:
                    pages = reader(bytes(content), dpi, most)
                    text = "\n\n".join(f"===== Page {k} OCR =====\n\n{t.strip()}" for k, t in enumerate(pages, 1))
                    rows.append((path, extraction_state(text.replace(" OCR =====", " =====")), text, len(pages), ""))
                except Exception as e:  # noqa: BLE001 - a bad file is a row
                    rows.append((path, "error", "", 0, f"{type(e).__name__}: {e}"[:500]))
            if rows:
                yield pd.DataFrame(rows, columns=["path", "status", "text", "pages", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, status string, text string, pages int, error string")
