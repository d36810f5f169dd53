"""The filter object every report takes, and its predicates."""

from __future__ import annotations

from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S

# Fixed value: the latest instant a range may end at.
END_OF_TIME = 32_503_680_000_000


class QueryError(ValueError):
    """A filter that cannot be answered."""


@dataclass(frozen=True)
class Query:
    """Half-open range [start, end) in epoch ms plus optional equality filters. ``bucket_ms`` sets the width of
    series buckets; without it the width follows from the range."""

    start: int
    end: int
    agent: str | None = None
    model: str | None = None
    project: str | None = None
    session: str | None = None
    search: str = ""
    offset_minutes: int = 0
    time_zone: str | None = None
    bucket_ms: int | None = None

    def validate(self) -> "Query":
        if self.start < 0 or self.end <= self.start or self.end > END_OF_TIME:
            raise QueryError("bad range: the start must come before the end")
        if not -1440 <= self.offset_minutes <= 1440:
            raise QueryError("bad offset: at most one day either way")
        if self.bucket_ms is not None and self.bucket_ms <= 0:
            raise QueryError("bad bucket: its width must be positive")
        if self.time_zone is not None:
            try:
                ZoneInfo(self.time_zone)
            except Exception as error:
                raise QueryError(f"bad time zone: {self.time_zone}") from error
        return self

    @property
    def narrows_sessions(self) -> bool:
        """Filters that only token events can answer, not tool calls."""
        return self.model is not None or self.project is not None or bool(self.search)


def range_predicate(q: Query) -> Column:
    return (F.col("ts") >= q.start) & (F.col("ts") < q.end)


def model_predicate(model: str) -> Column:
    """Equality, except that unattributed usage is addressed only by its own key."""
    nameless = (F.col("agent") == S.CREDIT_AGENT) & (F.col("model") == S.UNKNOWN_MODEL)
    if model == S.UNATTRIBUTED_MODEL:
        return (F.col("model") == model) | nameless
    return (F.col("model") == model) & ~nameless


def project_predicate(project: str) -> Column:
    """Equality of project keys, so spellings of one Windows path match each other."""
    return S.project_key("project") == S.project_key(F.lit(project))


def predicate(q: Query) -> Column:
    """Everything but the text search. Only set filters appear, so all of it pushes down."""
    out = range_predicate(q)
    if q.agent is not None:
        out = out & (F.col("agent") == q.agent)
    if q.session is not None:
        out = out & (F.col("session") == q.session)
    if q.model is not None:
        out = out & model_predicate(q.model)
    if q.project is not None:
        out = out & project_predicate(q.project)
    return out


def with_titles(events: DataFrame, files: DataFrame) -> DataFrame:
    """Adds the source file's ``title``; the key includes the agent, two may share a file."""
    titles = files.where("title IS NOT NULL").select("path", "agent", "title")
    return events.drop("title").join(titles, ["path", "agent"], "left")


def search_filter(events: DataFrame, files: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring over model, project, session and title.

    Rows already matched by their own columns skip the title join.
    """
    if not text:
        return events
    wanted = F.lower(F.lit(text))
    titled = with_titles(events, files)
    hay = F.lower(
        F.concat_ws(" ", "model", "project", "session", F.coalesce("title", F.lit("")))
    )
    return titled.where(F.contains(hay, wanted)).select(events.columns)


def select_events(events: DataFrame, q: Query, files: DataFrame | None = None) -> DataFrame:
    q.validate()
    out = events.where(predicate(q))
    if q.search:
        if files is None:
            raise QueryError("a text search needs the source files for their titles")
        out = search_filter(out, files, q.search)
    return out


def disable_agents(events: DataFrame, agents: list[str]) -> DataFrame:
    return events.where(~F.col("agent").isin(agents)) if agents else events


def select_activities(
    activities: DataFrame, events: DataFrame, q: Query, files: DataFrame | None = None
) -> DataFrame:
    """Tool calls of the range. Model, project and search only apply to whole sessions: a call
    stays if its session has a matching event."""
    q.validate()
    plain = range_predicate(q)
    if q.agent is not None:
        plain = plain & (F.col("agent") == q.agent)
    if q.session is not None:
        plain = plain & (F.col("session") == q.session)
    out = activities.where(plain)
    if q.narrows_sessions:
        sessions = select_events(events, q, files).select("agent", "session").dropDuplicates()
        out = out.join(sessions, ["agent", "session"], "left_semi")
    return out


def event_rows(priced: DataFrame) -> DataFrame:
    """Detail rows with their cost; NULL cost means no price is known."""
    return priced.select(
        "id", "agent", "session", "project", "model", "ts", "input", "cached", "cache_write",
        "output", "reasoning", S.total_tokens().alias("total_tokens"), "path", "cost",
    )
