"""What the plans look like when nothing is small enough to broadcast."""

import re

import pytest
from conftest import TESTDATA

from checks.registry import QUERIES
from eventide.operators import event_metrics as metrics
from eventide.plans import questions
from eventide.plans.market import LiveViews
from eventide.plans.store import TableStore, StoredViews, refresh
from eventide.session import tune
from eventide.sources.event_log import load_market

FOLDER = f"{TESTDATA}/sf0.001"
START, END = "2024-01-01 00:00:00", "2024-01-31 23:59:59"


@pytest.fixture
def large(spark):
    """Plan as for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_cross_the_network_once_for_returns_and_window_join(large):
    text = plan(LiveViews(load_market(large, FOLDER)).event_markouts())
    join = re.search(r"SortMergeJoin \[symbol#\d+, day#\d+, _slot#\d+L?\]", text)
    assert join, text
    # Between the join and the window over the bars there is a sort but no exchange.
    below = text[join.start():]
    right = below[below.index("- Window [lag") - 2500: below.index("- Window [lag")]
    assert "Exchange" not in right.split("Generate explode(sequence")[-1].split("FileScan")[-1]
    assert text.count("hashpartitioning(symbol") <= 6


@pytest.mark.parametrize("name", sorted(
    name for name in QUERIES if not name.startswith(("stored_", "csv_", "archive_")) and not name.endswith("_stored")
))
def test_no_pairwise_join_except_with_one_row(large, name):
    text = plan(QUERIES[name](large, FOLDER))
    for join in re.finditer("CartesianProduct", text):  # the arguments of a table function are one row
        assert "Scan OneRowRelation" in text[join.end() :].split("\n")[1]
    for join in re.finditer(r"BroadcastNestedLoopJoin|BroadcastExchange IdentityBroadcastMode", text):
        if "Identity" in join[0]:  # what is paired with every row is one row: a single aggregate of all rows
            below = text[join.end() :].split("\n")[1:4]
            assert any(re.search(r"Aggregate\(keys=\[\]|OneRowRelation", line) for line in below), below


def test_tiles_and_percentiles_over_all_rows_do_not_use_one_task(large):
    views = LiveViews(load_market(large, FOLDER))
    # The first takes the day before an event by hours: one join with whole hours, one with the rows at the ends.
    asked = {views.event_volatility(): 2, views.vol_regime_events(): 1, questions.low_vol_safe_symbols(views, START, END): 1}
    for df, joins in asked.items():
        text = plan(df)
        # What meets in one task are counts: of ranges, steps, and the few values of one step.
        for below in re.findall(r"Exchange SinglePartition[^\n]*\n([^\n]*\n[^\n]*)", text):
            assert "HashAggregate" in below, below
        # The events meet the bars once, however many steps the selection takes.
        assert len(re.findall(r"SortMergeJoin \[symbol#\d+, day#\d+, _slot#\d+L?\]", text)) == joins
        assert not re.search(r"\bntile\(", text) and not re.search(r"rangepartitioning\(rv_", text) and "InMemoryTableScan" not in text


def test_a_range_reaches_the_scan_of_the_log(large):
    views = LiveViews(load_market(large, FOLDER))
    large.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        text = plan(questions.hourly_markouts(views, "2024-01-10", "2024-01-12"))
    finally:
        large.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", text)
    assert pushed and all("LessThanOrEqual(ts,2024-01-12T" in p for p in pushed)
    assert any("GreaterThanOrEqual(ts,2024-01-10T" in p for p in pushed)


def test_building_a_question_starts_no_job(spark):
    views = LiveViews(load_market(spark, FOLDER))
    context = spark.sparkContext
    context.setJobGroup("building", "questions are lazy")
    try:
        for ask in (
            questions.event_car, questions.funding_deciles, questions.extreme_regimes, questions.low_vol_safe_symbols,
            questions.hourly_markouts, questions.vol_regime_markouts, questions.symbol_overview, questions.funding_pressure,
            questions.post_event_volatility, questions.positive_moves_30m, questions.median_daily_vol,
        ):
            ask(views, START, END)
        assert list(context.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_repeated_key_is_cut_before_the_shuffle(large):
    text = plan(QUERIES["upsert_ignore"](large, FOLDER))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_shuffles_start_as_fine_as_the_input_needs(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        assert tune(spark, 100 * 2**40).conf.get(name) == str(100 * 2**40 // 2**27)
        assert tune(spark, 1).conf.get(name) == spark.conf.get("spark.sql.shuffle.partitions")
    finally:
        spark.conf.unset(name)


def test_scan_reads_only_what_is_needed(large):
    text = plan(LiveViews(load_market(large, FOLDER)).funding().filter("symbol = 'click'"))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text
    assert "EqualTo(event_type,click)" in text


def test_live_returns_prune_older_days_while_they_run(large, tmp_path):
    """Every scan of the bars is cut by day: by the range itself, or by the days that hold lead-in rows."""
    store = TableStore(large, str(tmp_path))
    market = load_market(large, FOLDER)
    for name in ("klines", "funding", "open_interest", "premium_index"):
        store.write(name, getattr(market, name))
    views = LiveViews(store.market(market.symbols))
    context = large.sparkContext
    large.conf.set("spark.sql.maxMetadataStringLength", "3000")
    context.setJobGroup("pruning", "planned, not run")
    try:
        question = questions.hourly_markouts(views, "2024-01-10", "2024-01-12")
        text = plan(question)
        assert list(context.statusTracker().getJobIdsForGroup("pruning")) == []
    finally:
        large.conf.unset("spark.sql.maxMetadataStringLength")
        context.setLocalProperty("spark.jobGroup.id", None)
    scans = [line for line in text.splitlines() if "FileScan" in line and "close_price" in line]
    filters = [re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", line)[1] for line in scans]
    assert len(filters) >= 3 and all("dynamicpruningexpression(day" in f or "day#" in f and ">= 2024-01-10" in f for f in filters), filters
    assert any("dynamicpruningexpression(day" in f for f in filters)
    read = _files_read(large, question)
    assert read < _files_read(large, questions.hourly_markouts(LiveViews(store.market(market.symbols, bar_days=None)), "2024-01-10", "2024-01-12"))


def _files_read(spark, df) -> int:
    """Files that the scans of bars opened when the query ran."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    found = 0
    pending = [execution.executedPlan()]
    while pending:
        node = pending.pop()
        if node.nodeName().startswith("Scan parquet") and "close_price" in node.simpleString(100):
            found += node.metrics().apply("numFiles").value()
        children = node.children()
        pending += [children.apply(i) for i in range(children.size())]
    return found
