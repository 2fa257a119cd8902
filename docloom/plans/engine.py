"""The engine: index documents into the two layers, ask questions, save and load."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.encode import FORMATTERS
from docloom.operators import entities as E
from docloom.operators import regions as R
from docloom.operators import retrieval, spatial
from docloom.operators.mentions import extract_mentions
from docloom.operators.statistics import indexing_statistics
from docloom.sources import files
from docloom.sources.regions import regions_from_lines
from docloom.sources.store import at_once, sweep
from docloom.sources.store import compressed as materialise


@dataclass(frozen=True)
class Config:
    """Settings; ``Config.merged`` lays a nested dictionary over the defaults."""

    near_duplicates: float = 0.9
    least_text: int = 10
    terms: int = 5000
    formatter: str = "toon"
    scope: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)

    @classmethod
    def merged(cls, values: dict) -> Config:
        known = {k: (tuple(v) if isinstance(v, list) else v) for k, v in values.items() if k in cls.__dataclass_fields__ and k != "options"}
        return cls(**known, options={k: v for k, v in values.items() if k not in cls.__dataclass_fields__})


def deep_merge(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``, dictionary by dictionary."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


class Tables(dict):
    """Tables by name; those of ``later`` are made and written when they are first asked for."""

    def __init__(self, now: dict[str, DataFrame], later: dict[str, Callable[[Tables], DataFrame]], numbered: Tables | None = None) -> None:
        super().__init__(now | dict.fromkeys(later))
        self._later = dict(later)
        self.numbered = numbered  # numbers of the entities, and the relations of these numbers: no tables of the index

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._later:
            self[name] = self._later.pop(name)(self)
        return super().__getitem__(name)

    def get(self, name: str, default: DataFrame | None = None) -> DataFrame | None:
        return self[name] if name in self else default

    def items(self):
        return [(name, self[name]) for name in self]

    def values(self):
        return [self[name] for name in self]


class Layers(retrieval.Corpus):
    """The tables of an engine as retrieval reads them: those that no strategy reads are never made."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.tables = tables
        self.regions, self.entities, self.captions = tables["regions"], tables["entities"], tables.get("figure_caption")

    relations = property(lambda self: self.tables["relationships"])
    bridge = property(lambda self: self.tables["entity_region"])

    def related(self, found: DataFrame, most: int, nodes: int) -> DataFrame:
        known = getattr(self.tables, "numbered", None)
        if known is None:
            return super().related(found, most, nodes)
        numbers = known["numbers"].select("entity_id", "number")
        asked = found.select("query_id", "entity_id").join(numbers, "entity_id").select("query_id", F.col("number").alias("entity_id"))
        return E.by_name(retrieval._relations_of(asked, known["relations"], most, nodes, once=True), numbers)


class Engine:
    """Tables of the two layers, and what is asked of them."""

    def __init__(self, spark: SparkSession, config: Config | None = None) -> None:
        self.spark = spark
        self.config = config or Config()
        self.tables: dict[str, DataFrame] = {}
        self._corpus: retrieval.Corpus | None = None  # with its text index, which is written once

    def index(self, docs: DataFrame, greedy: bool = False) -> Engine:
        """Build both layers from documents (doc_id, text); ``greedy`` also drops near-duplicate regions."""
        return self.index_regions(regions_from_lines(docs), greedy)

    def index_regions(self, regions: DataFrame, greedy: bool = False) -> Engine:
        regions = materialise(regions, "regions")
        kept = R.exact_unique(R.admitted(regions, self.config.least_text))
        if greedy:
            kept = R.near_unique(kept, self.config.near_duplicates)
        # What several tables are made from is written once; the rest are plans over it.
        def named() -> tuple[DataFrame, DataFrame]:
            mentions = materialise(extract_mentions(regions), "mentions")
            return mentions, materialise(E.merge_entities(mentions, self.config.scope), "entities")

        nodes, (mentions, merged) = at_once(lambda: materialise(R.nodes(kept), "nodes"), named)
        later = {
            "entity_region": lambda _: materialise(E.linked_regions(E.entity_regions(merged, mentions, self.config.scope), nodes), "entity-region"),
            "relationships": lambda t: E.by_name(t.numbered["relations"], t.numbered["numbers"]),
        }

        def relations(known: Tables) -> DataFrame:
            # Pairs are made, compared and moved as numbers: ids are longer than the rest of a relation.
            few, bridge = (E.by_number(t, known["numbers"]) for t in (merged, self.tables["entity_region"]))
            made = materialise(E.all_relations(few, bridge, E.entity_pages(few, mentions, self.config.scope), regions), "relationships")
            sweep(self.spark)
            return made

        numbered = Tables({}, {"numbers": lambda _: materialise(E.numbered(merged), "numbers"), "relations": relations})
        self.tables = Tables({"regions": regions, "nodes": nodes, "spatial_edges": spatial.spatial_edges(nodes), "mentions": mentions, "entities": merged, "figure_caption": spatial.figure_captions(nodes)}, later, numbered)
        sweep(self.spark)
        return self

    def corpus(self) -> retrieval.Corpus:
        t = self.tables
        if self._corpus is None or self._corpus.regions is not t["regions"]:
            self._corpus = Layers(t)
        return self._corpus

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """Contexts of a batch of questions (query_id, question[, override_level])."""
        return retrieval.assemble(retrieval.retrieve(questions, self.corpus()))

    def ask(self, question: str, level: int | None = None) -> str:
        """One question's context rows, formatted."""
        asked = self.spark.createDataFrame([(0, question, level)], "query_id long, question string, override_level int")
        rows = retrieval.retrieve(asked, self.corpus()).orderBy("part", "rank", "ref").collect()
        return FORMATTERS[self.config.formatter]({"question": question, "context": [{"kind": r["kind"], "ref": r["ref"], "content": r["content"]} for r in rows]})

    def statistics(self) -> DataFrame:
        return indexing_statistics(self.tables["regions"])

    def save(self, folder: str, buckets: int | None = None) -> None:
        files.save_tables(self.tables, folder, buckets)

    def load(self, folder: str, doc_id=None) -> Engine:
        """Tables of a saved index; of one document only, where they have its id."""
        found = files.load_tables(self.spark, folder)
        self.tables = {n: df.where(F.col("doc_id") == doc_id) if doc_id is not None and "doc_id" in df.columns else df for n, df in found.items()}
        return self
