"""All registered queries of the library outside the data-preparation subpackage: name to (function, SQL or None)."""

from __future__ import annotations

from mnemoframe.plans import memory, retrieval, streams, texts

CATALOG: dict[str, tuple] = {**texts.CATALOG, **memory.CATALOG, **retrieval.CATALOG, **streams.CATALOG}
FLAGSHIP = "d18_hybrid"
