"""Channel names, groups and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Channel names of each layout, in the layout's own order.
LAYOUTS = {
    "mono": "FC",
    "stereo": "Channel 1 Left,Channel 2 Right",
    "2.1": "FL,FR,LFE",
    "3.0": "FL,FR,FC",
    "3.0(back)": "FL,FR,BC",
    "4.0": "FL,FR,FC,BC",
    "quad": "FL,FR,SBL,SBR",
    "quad(side)": "FL,FR,SL,SR",
    "3.1": "FL,FR,FC,LFE",
    "5.0": "FL,FR,FC,SBL,SBR",
    "5.0(side)": "FL,FR,FC,SL,SR",
    "4.1": "FL,FR,FC,LFE,BC",
    "5.1": "FL,FR,FC,LFE,SBL,SBR",
    "5.1(side)": "FL,FR,FC,LFE,SL,SR",
    "6.0": "FL,FR,FC,BC,SL,SR",
    "6.0(front)": "FL,FR,FLC,FRC,SL,SR",
    "3.1.2": "FL,FR,FC,LFE,TFL,TFR",
    "hexagonal": "FL,FR,FC,SBL,SBR,BC",
    "6.1": "FL,FR,FC,LFE,BC,SL,SR",
    "6.1(back)": "FL,FR,FC,LFE,SBL,SBR,BC",
    "6.1(front)": "FL,FR,LFE,FLC,FRC,SL,SR",
    "7.0": "FL,FR,FC,SBL,SBR,SL,SR",
    "7.0(front)": "FL,FR,FC,FLC,FRC,SL,SR",
    "7.1": "FL,FR,FC,LFE,SBL,SBR,SL,SR",
    "7.1(wide)": "FL,FR,FC,LFE,SBL,SBR,FLC,FRC",
    "7.1(wide-side)": "FL,FR,FC,LFE,FLC,FRC,SL,SR",
    "5.1.2": "FL,FR,FC,LFE,SBL,SBR,TFL,TFR",
    "octagonal": "FL,FR,FC,SBL,SBR,BC,SL,SR",
    "cube": "FL,FR,SBL,SBR,TFL,TFR,TBL,TBR",
    "5.1.4": "FL,FR,FC,LFE,SBL,SBR,TFL,TFR,TBL,TBR",
    "7.1.2": "FL,FR,FC,LFE,SBL,SBR,SL,SR,TFL,TFR",
    "7.1.4": "FL,FR,FC,LFE,SBL,SBR,SL,SR,TFL,TFR,TBL,TBR",
    "7.2.3": "FL,FR,FC,LFE,SBL,SBR,SL,SR,TFL,TFR,TBC,LFE2",
    "9.1.4": "FL,FR,FC,LFE,SBL,SBR,FLC,FRC,SL,SR,TFL,TFR,TBL,TBR",
    "hexadecagonal": "FL,FR,FC,SBL,SBR,BC,SL,SR,TFL,TFC,TFR,TBL,TBC,TBR,WL,WR",
    "downmix": "DL,DR",
    "22.2": "FL,FR,FC,LFE,SBL,SBR,FLC,FRC,BC,SL,SR,TC,TFL,TFC,TFR,TBL,TBC,TBR,LFE2,TSL,TSR,BFC,BFL,BFR",
}
# Names by channel count, where no layout is known.
COUNTS = {
    1: "FC",
    2: "Channel 1 Left,Channel 2 Right",
    3: "FL,FC,FR",
    4: "FL,FR,SL,SR",
    5: "FL,FC,FR,SL,SR",
    6: "FL,FC,FR,SL,SR,LFE",
    7: "FL,FC,FR,SL,SR,SBL,SBR",
    8: "FL,FC,FR,SL,SR,SBL,SBR,LFE",
    9: "FL,FC,FR,SL,SR,SBL,SBR,TFL,TFR",
    10: "FL,FC,FR,SL,SR,SBL,SBR,TFL,TFR,LFE",
    11: "FL,FC,FR,SL,SR,SBL,SBR,TFL,TFR,TBL,TBR",
    12: "FL,FC,FR,SL,SR,SBL,SBR,TFL,TFR,TBL,TBR,LFE",
}
# Tokens of the groups.
SCREEN = ("FL", "FR", "FC", "FLC", "FRC")
SURROUND = ("SL", "SR", "SBL", "SBR", "BL", "BR", "BC", "TFL", "TFR", "TBL", "TBR", "TFC", "TBC", "TSL", "TSR", "WL", "WR")
# Names of compact configurations by group and number, and content types by folder.
FRONT = {1: "FC", 2: "FL,FR", 3: "FL,FC,FR", 5: "FL,FCL,FC,FCR,FR"}
MIDDLE = {2: "SL,SR", 4: "SL,SR,SL1,SR1"}
REAR = {2: "SBL,SBR", 4: "SBL,SBR,SBL,SBR"}
# Folders that were grouped by name, and the beginnings of the others.
SCREEN_FOLDERS = ("Channel 1 FL", "Channel 2 FR", "Channel 3 FC", "Channel 1 Front Left", "Channel 2 Front Right", "Channel 3 Front Center")
LFE_FOLDERS = ("Channel 4 LFE", "Channel 5 LFE", "Channel 6 LFE", "Channel 4 Low Frequency Effects", "Channel 5 Low Frequency Effects")
SURROUND_FOLDERS = ("Channel 5", "Channel 6", "Channel 7", "Channel 8", "Channel 9", "Channel 10", "Channel 11", "Channel 12")
CONTENT = {"Music": "Music", "Film": "Film", "Test Signals": "Test Signal"}


def layout_frame(spark: SparkSession) -> DataFrame:
    """``(layout, channel_index, channel_name)``, a fixed dimension of some hundred rows."""
    rows = spark.createDataFrame([(k, v) for k, v in LAYOUTS.items()], "layout string, names string")
    return rows.select("layout", F.posexplode(F.split("names", ",")).alias("channel_index", "channel_name"))


def count_frame(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(k, v) for k, v in COUNTS.items()], "total_channels int, names string")
    return rows.select("total_channels", F.posexplode(F.split("names", ",")).alias("channel_index", "channel_name"))


def with_channel_name(df: DataFrame) -> DataFrame:
    """Adds ``channel_name`` to ``(channel_index, total_channels, layout)``: stereo, layout, count, then a number.

    Both dimensions are fixed and tiny, so they are broadcast. An index outside
    of the channels is an error.
    """
    by_layout = layout_frame(df.sparkSession).select(F.col("layout").alias("_l"), F.col("channel_index").alias("_i"), F.col("channel_name").alias("_by_layout"))
    by_count = count_frame(df.sparkSession).select(F.col("total_channels").alias("_n"), F.col("channel_index").alias("_j"), F.col("channel_name").alias("_by_count"))
    i, n = F.col("channel_index"), F.col("total_channels")
    checked = df.withColumn("_k", F.when((i < 0) | (i >= n), F.raise_error(F.concat(F.lit("channel index out of range: "), i)).cast("int")).otherwise(i))
    named = checked.join(F.broadcast(by_layout), (F.lower(F.trim("layout")) == F.col("_l")) & (F.col("_k") == F.col("_i")), "left")
    named = named.join(F.broadcast(by_count), (n == F.col("_n")) & (F.col("_k") == F.col("_j")), "left")
    stereo = F.when((n == 2) & (F.col("_k") == 0), "Channel 1 Left").when((n == 2) & (F.col("_k") == 1), "Channel 2 Right")
    name = F.coalesce(stereo, "_by_layout", "_by_count", F.concat(F.lit("Channel "), (i + 1).cast("string")))
    return named.select(*df.columns, name.alias("channel_name"))


def folder_name(name: Column, index: Column, total: Column) -> Column:
    return F.when(total == 2, name).otherwise(F.concat_ws(" ", F.lit("Channel"), (index + 1).cast("string"), name))


def parse_config(config: Column) -> Column:
    """Names of a compact configuration such as ``3F2M2R/LFE``; null where it names none."""
    parts = F.split(F.upper(config), "/")

    def group(letter: str, names: dict[int, str]) -> Column:
        n = F.regexp_extract(parts[0], rf"(\d+){letter}", 1)
        out = F.array().cast("array<string>")
        for k, v in names.items():
            out = F.when(n == str(k), F.array(*map(F.lit, v.split(",")))).otherwise(out)
        return out

    lfe = F.when(F.coalesce(F.get(parts, F.lit(1)).contains("LFE"), F.lit(False)), F.array(F.lit("LFE"))).otherwise(F.array().cast("array<string>"))
    names = F.concat(group("F", FRONT), group("M", MIDDLE), group("R", REAR), lfe)
    return F.when(F.size(names) > 0, names)


def classify(name: Column) -> Column:
    """screen, lfe or surround by whole tokens of a name, else null."""
    plain = F.trim(F.regexp_replace(F.upper(name), "CHANNEL", " "))
    tokens = F.transform(F.filter(F.split(F.translate(plain, "_/", "  "), r"\s+"), lambda t: t != ""), lambda t: F.regexp_replace(t, r"^[()\[\],:;-]+|[()\[\],:;-]+$", ""))
    has = lambda names: F.arrays_overlap(tokens, F.array(*map(F.lit, names)))
    late = F.substring(name, 1, 9).isin("Channel 5", "Channel 6", "Channel 7", "Channel 8")
    return (
        F.when(has(SCREEN), "screen")
        .when(F.exists(tokens, lambda t: t.startswith("LFE")) | plain.contains("LOW FREQUENCY"), "lfe")
        .when(has(SURROUND) | late, "surround")
    )


def group_of(name: Column, index: Column) -> Column:
    """:func:`classify`, or by the index where the name says nothing."""
    return F.coalesce(classify(name), F.when(index.between(0, 2), "screen").when(index == 3, "lfe").when(index >= 4, "surround"))


def group_label(group: Column) -> Column:
    return F.when(group == "screen", "Screen").when(group == "lfe", "LFE").when(group == "surround", "Surround+Height").otherwise("All Channels")


def legacy_group(folder: Column) -> Column:
    """Grouping by fixed folder names and prefixes."""
    late = F.lit(False)
    for prefix in SURROUND_FOLDERS:
        late = late | folder.startswith(prefix)
    return F.when(folder.isin(*SCREEN_FOLDERS), "Screen").when(folder.isin(*LFE_FOLDERS), "LFE").when(late, "Surround+Height").otherwise("All Channels")


def filter_tokens(*values: Column) -> Column:
    """Normalised and alphanumeric forms of names, for matching channel filters."""
    plain = F.filter(F.transform(F.array(*values), lambda v: F.trim(F.lower(v))), lambda v: v.isNotNull() & (v != ""))
    return F.array_distinct(F.concat(plain, F.transform(plain, lambda v: F.regexp_replace(v, r"[^\p{L}\p{N}]", ""))))


def content_type(path: Column) -> Column:
    parent = F.try_element_at(F.split(path, "/"), F.lit(-2))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in CONTENT.items() for x in kv))[parent], F.lit("Unknown"))
