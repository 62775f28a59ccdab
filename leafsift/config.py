"""Settings and fixed tables of the engine."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# Words the lexical lane ignores.
STOP_WORDS = (
    "de", "da", "do", "das", "dos", "e", "a", "o", "as", "os",
    "para", "por", "em", "no", "na", "nos", "nas",
    "com", "sem", "um", "uma", "uns", "umas", "ao", "aos",
)

# Groups of equivalent terms, in order.
SYNONYM_GROUPS = (
    ("cefaleia", "dor de cabeça"),
    ("hipertensão", "hipertensão arterial", "pressão alta"),
    ("hipotensão", "pressão baixa"),
    ("náusea", "enjoo"),
    ("êmese", "vômito"),
    ("pirose", "azia"),
    ("astenia", "fraqueza", "cansaço"),
    ("mialgia", "dor muscular"),
    ("artralgia", "dor nas articulações"),
    ("dispneia", "falta de ar"),
    ("prurido", "coceira"),
    ("edema", "inchaço"),
    ("vertigem", "tontura"),
    ("epistaxe", "sangramento nasal"),
    ("dispepsia", "má digestão"),
)

# Metadata fields kept from a leaflet's header.
METADATA_FIELDS = (
    "doenca", "nome_medicamento", "nome_comercial",
    "medgenerico", "medreferencia", "fabricante", "apresentacao",
)

# Words that look like brands and are none.
NO_BRANDS = ("Anvisa", "MS", "SAC", "Reg")


@dataclass(frozen=True)
class CorpusType:
    """One corpus: its map of drugs, its folders of tagged leaflets and of bare texts, the endings of its file names."""

    tipo: str
    map_csv: str
    original_dir: str
    simplified_dir: str
    original_suffix: str
    simplified_suffix: str
    original_texts: str
    simplified_texts: str


# The layout of the two corpora under a root folder. Other layouts are other CorpusType values.
CORPUS_TYPES = (
    CorpusType(
        "hipertensao", "remedios_ht_map.csv", "csv_metadata/ht/original", "csv_metadata/ht/simplificada",
        "_original_limpo.txt", "_validada_limpo.txt", "csv/ht/original", "csv/ht/simplificada",
    ),
    CorpusType(
        "oncologia", "remedios_onco_map.csv", "csv_metadata/onco/original", "csv_metadata/onco/simplificada",
        "_original_limpo.txt", "_simplificada_limpo.txt", "csv/onco/original", "csv/onco/simplificada",
    ),
)

# The models a search asks for by default, and the most tokens they read.
EMBEDDING_MODEL, EMBEDDING_TOKENS = "BAAI/bge-m3", 8192
RERANKING_MODEL, RERANKING_TOKENS = "BAAI/bge-reranker-v2-m3", 512


@dataclass(frozen=True)
class Settings:
    """Search settings; the environment may override the two reranker ones."""

    chunk_chars: int = 600
    sentence_chars: int = 15
    crop_words: int = 30
    pool_factor: int = 20
    pool_least: int = 60
    rerank_pool: int = field(default_factory=lambda: int(os.getenv("RERANK_POOL_MAX", "30")))
    rerank_min_score: float = field(default_factory=lambda: float(os.getenv("RERANK_MIN_SCORE", "0.1")))
    min_score: float = 0.45
    metric: str = "cosine"
    stop_words: tuple[str, ...] = STOP_WORDS

    def pool(self, limit: int, count: int) -> int:
        return min(max(limit * self.pool_factor, self.pool_least), count)


def check_request(q: str, n: int, min_score: float, min_score_rerank: float | None) -> None:
    """The ranges a request must keep: a query, 1 to 50 results, scores between 0 and 1."""
    if not q:
        raise ValueError("q must not be empty")
    if not 1 <= n <= 50:
        raise ValueError("n must be between 1 and 50")
    for s in (min_score, min_score_rerank):
        if s is not None and not 0 <= s <= 1:
            raise ValueError("scores must be between 0 and 1")
