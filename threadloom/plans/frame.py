"""A DataFrame with column roles; whatever it doesn't define itself it passes on to the DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import code, messages, text, validate, vectors
from threadloom.functions.tokens import DEFAULT, Tokenizer
from threadloom.operators import cluster, generate, search, strata
from threadloom.schema import embedding_col, tokens_col, tokens_len_col
from threadloom.sources import files


@dataclass(frozen=True)
class Roles:
    context_columns: tuple[str, ...] = ()
    embeddable_columns: tuple[str, ...] = ()
    embedding_columns: tuple[str, ...] = ()
    time_series_columns: tuple[str, ...] = ()
    name: str = "frame"
    meta: dict = field(default_factory=dict)


def embeddable_type(df: DataFrame, column: str) -> str:
    """`text` or `numeric`; any other type can't be embedded."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, T.NumericType):
        return "numeric"
    raise TypeError(f"{column}: {kind.simpleString()} can't be embedded")


class Frame:
    """Each method returns a new frame or a DataFrame; nothing is changed in place."""

    def __init__(self, df: DataFrame, roles: Roles = Roles(), tokenizer: Tokenizer = DEFAULT):  # noqa: B008 (frozen)
        missing = [c for c in (*roles.context_columns, *roles.embeddable_columns, *roles.embedding_columns, *roles.time_series_columns) if c not in df.columns]
        if missing:
            raise ValueError(f"no column {missing[0]!r}")
        self.df, self.roles, self.tokenizer = df, roles, tokenizer

    def __getattr__(self, name: str):
        """DataFrame methods; those that return a DataFrame return a frame with the roles that are left."""
        if name.startswith("__") or name in ("df", "roles", "tokenizer"):
            raise AttributeError(name)
        got = getattr(self.df, name)
        if not callable(got):
            return got

        def call(*args, **kwargs):
            out = got(*args, **kwargs)
            return self._with(out) if isinstance(out, DataFrame) else out

        return call

    def _with(self, df: DataFrame, **roles) -> Frame:
        have = set(df.columns)
        changed = replace(self.roles, **roles)
        kept = {k: tuple(c for c in getattr(changed, k) if c in have) for k in ("context_columns", "embeddable_columns", "embedding_columns", "time_series_columns")}
        return Frame(df, replace(changed, **kept), self.tokenizer)

    def overwritten_attributes(self) -> list[str]:
        """Names that the frame defines over the DataFrame's."""
        return sorted(n for n in vars(type(self)) if not n.startswith("_") and hasattr(DataFrame, n))

    def set_embeddable_columns(self, *names: str) -> Frame:
        if missing := [n for n in names if n not in self.df.columns]:
            raise ValueError(f"no column {missing[0]!r}")
        return self._with(self.df, embeddable_columns=tuple(dict.fromkeys((*self.roles.embeddable_columns, *names))))

    def columns_with_prefix(self, prefix: str) -> list[str]:
        return [c for c in self.df.columns if c.startswith(prefix)]

    def apply_expression(self, condition: Column | str) -> Frame:
        return self._with(self.df.filter(condition))

    def tokenize_column(self, column: str) -> Frame:
        """Adds `tokens|column` and `tokens_len|column`."""
        ids = self.df.withColumn(tokens_col(column), self.tokenizer.ids(F.col(f"`{column}`")))
        return self._with(ids.withColumn(tokens_len_col(column), F.when(F.col(f"`{column}`").isNotNull(), F.size(f"`{tokens_col(column)}`"))))

    def apply_validator_to_column(self, column: str, validator: Callable[[Column], Column] = validate.text, fail: bool = True) -> Frame:
        return self._with(validate.checked(self.df, column, validator, self.roles.embeddable_columns or None, fail))

    def convert_column_to_messages(self, column: str, model: str = generate.DEFAULT_MODEL, system_prompt: str = messages.DEFAULT_SYSTEM) -> Frame:
        return self._with(self.df.withColumn("messages", messages.request_messages(F.col(f"`{column}`"), system_prompt)).withColumn("model", F.lit(model)))

    def prepare_column_for_embeddings(self, column: str, model: str = "text-embedding-ada-002") -> DataFrame:
        return self.df.select(F.col(f"`{column}`").alias("input"), F.lit(model).alias("model"))

    def embed_column(self, column: str, row_id: str, provider: Callable[[], generate.Embedder], **store) -> Frame:
        """Adds `embedding|column`; a number is a vector of itself."""
        name = embedding_col(column)
        if embeddable_type(self.df, column) == "numeric":
            out = self.df.withColumn(name, vectors.numeric_embedding(F.col(f"`{column}`")))
        else:
            out = generate.embedded(self.df, column, row_id, provider, name, **store)
        return self._with(out, embedding_columns=(*self.roles.embedding_columns, name))

    def generate_column(self, column: str, row_id: str, provider: Callable[[], generate.Generator], system_prompt: str = messages.DEFAULT_SYSTEM, output: str = "output", **store) -> Frame:
        return self._with(generate.generated(self.df, column, row_id, provider, system_prompt, output, **store))

    def search_column(self, query: Sequence[float], column: str, k: int, key: str) -> Frame:
        return self._with(search.top_k(self.df, query, column, k, key))

    def search_column_with_sql(self, predicate: str, query: Sequence[float], column: str, k: int, key: str) -> Frame:
        return self._with(search.top_k_where(self.df, predicate, query, column, k, key))

    def entity_filter(self, column: str, entities: Sequence[str]) -> Frame:
        return self._with(self.df.filter(text.any_of(F.col(f"`{column}`"), entities)))

    def cluster_embeddings(self, column: str, key: str, stages: list | None = None, **settings) -> Frame:
        """Adds `cluster`: by the caller's estimators, else by PCA and k-means."""
        found = cluster.fitted(self.df, key, embedding_col(column), stages) if stages else cluster.reduced_kmeans(self.df, key, embedding_col(column), **settings)
        return self._with(self.df.join(found, key, "left"))

    def create_stratas(self, columns: Sequence[str] | None = None) -> Frame:
        return self._with(strata.create_stratas(self.df, columns or self.roles.context_columns))

    def count_node_types(self, column: str, prefix: str = "node_count", strict: bool = True) -> Frame:
        return self._with(code.count_node_types(self.df, column, prefix, strict))

    def count_operators(self, column: str, prefix: str = "operator_count") -> Frame:
        return self._with(code.count_operators(self.df, column, prefix))

    def apply_visitor_to_column(self, column: str, visitor: type, returns: str, prefix: str | None = None) -> Frame:
        return self._with(code.apply_visitor(self.df, column, visitor, returns, prefix))

    def save(self, path: str) -> None:
        """Parquet in `path`/data, and the roles as one JSON row beside it."""
        self.df.write.mode("overwrite").parquet(f"{path}/data")
        told = json.dumps(asdict(self.roles))
        self.df.sparkSession.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/roles")

    @classmethod
    def load(cls, spark: SparkSession, path: str, tokenizer: Tokenizer = DEFAULT) -> Frame:
        told = json.loads(spark.read.text(f"{path}/roles").first()[0])
        return cls(spark.read.parquet(f"{path}/data"), Roles(**{k: tuple(v) if isinstance(v, list) else v for k, v in told.items()}), tokenizer)

    @classmethod
    def from_python(cls, spark: SparkSession, directory: str, value_column: str = "code", **settings) -> Frame:
        return cls(files.python_values(spark, directory, value_column, **settings), Roles(embeddable_columns=(value_column,)))

    @classmethod
    def from_documentation(cls, spark: SparkSession, directory: str, value_column: str = "content") -> Frame:
        return cls(files.documentation(spark, directory, value_column), Roles(context_columns=("filename",), embeddable_columns=(value_column,)))

    @classmethod
    def from_dataset(cls, df: DataFrame, value_column: str, title: str = "title", body: str = "text") -> Frame:
        """Title and text merged into one value."""
        return cls(df.withColumn(value_column, text.title_and_text(F.col(title), F.col(body))), Roles(embeddable_columns=(value_column,)))
