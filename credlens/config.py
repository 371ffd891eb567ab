"""Run parameters with the defaults of the original application."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # --- fixed values (defaults that must equal the original configuration) ---
    raw_sources: tuple[str, ...] = ("climate", "news", "ukraine", "science", "verified_news")
    verified_sources: tuple[str, ...] = ("verified_news",)
    max_features: int = 5000
    min_df: int = 2
    ngram_range: tuple[int, int] = (1, 2)
    custom_stopwords: tuple[str, ...] = ("rt", "via", "amp")
    n_clusters: int = 8
    cluster_by: str = "label_lang"          # label | lang | label_lang | none
    explain_top_n: int = 15
    terms_in_text: int = 5
    alert_threshold: float = 0.7
    incremental_refresh_existing: bool = False
    incremental_limit: int = 0
    collection_caps: dict = field(default_factory=lambda: {
        "news": 15000, "climate": 15000, "ukraine": 15000, "science": 15000,
        "verified_news": 60000,
    })
    default_cap: int = 35000
    retention_days: int = 0
    langs_filter: tuple[str, ...] = ("en", "fr")
    crawl_max_pages: int = 5
    crawl_page_size: int = 100
    crawl_low_activity_limit: int = 3
    author_page_size: int = 50
    author_max_pages: int = 1
    posts_per_source: int = 2000
    preview_limit: int = 100
    kmeans_seed: int = 42
    kmeans_n_init: int = 10
    split_test_buckets: int = 1       # 1 of 5 hash buckets = 20 % test
    calibration_folds: int = 3
    grouped_kmeans_n_init: int = 10
    grouped_kmeans_max_iter: int = 300

    def __post_init__(self) -> None:
        tidy = {"langs_filter": str.strip, "custom_stopwords": lambda w: w.strip().lower()}
        for name, clean in tidy.items():
            values = (clean(v or "") for v in getattr(self, name))
            object.__setattr__(self, name, tuple(v for v in values if v))

    def cap_for(self, source: str) -> int:
        return int(self.collection_caps.get(source, self.default_cap))


DEFAULT = Params()
