"""The table of cameras and how far each is covered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rank, status, camera, format, sample.
CAMERAS = [
    (1, "Tested", "SIGMA fp", "CinemaDNG video; DNG stills", "In lab"),
    (2, "Sample wanted", "SIGMA fp L", "CinemaDNG video; DNG stills", "Needed"),
    (3, "Sample wanted", "Blackmagic Cinema Camera / Production Camera", "CinemaDNG sequences", "Needed"),
    (4, "Sample wanted", "Blackmagic Pocket Cinema Camera / Micro Cinema Camera", "CinemaDNG sequences", "Needed"),
    (5, "Sample wanted", "DJI Inspire RAW with Zenmuse X5R", "CinemaDNG sequences", "Needed"),
    (6, "Sample wanted", "DJI Inspire 2 with Zenmuse X5S / X7", "CinemaDNG sequences", "Needed"),
    (7, "Sample wanted", "Kinefinity MAVO / Terra", "CinemaDNG / KineRAW", "Needed"),
    (8, "Sample wanted", "Leica SL / SL2-S / SL3", "DNG stills", "Needed"),
    (9, "Sample wanted", "Panasonic S1H / BS1H", "External RAW workflows", "Needed"),
    (10, "Sample wanted", "Blackmagic Pocket Cinema Camera 4K / 6K / 6K Pro", "BRAW / ProRes; legacy CinemaDNG", "Needed"),
    (11, "Demand signal", "Blackmagic Cinema Camera 6K Full Frame", "BRAW / ProRes", "Optional"),
    (12, "Demand signal", "Blackmagic URSA Mini Pro 4.6K / 12K", "BRAW / ProRes; legacy CinemaDNG", "Optional"),
    (13, "Demand signal", "ARRI ALEXA Mini / Mini LF", "ARRIRAW / ProRes", "Optional"),
    (14, "Demand signal", "ARRI ALEXA 35", "ARRIRAW / ProRes", "Optional"),
    (15, "Demand signal", "RED KOMODO / KOMODO-X", "REDCODE RAW", "Optional"),
    (16, "Demand signal", "RED V-RAPTOR / DSMC3", "REDCODE RAW", "Optional"),
    (17, "Demand signal", "Sony FX3 / FX30", "XAVC; external ProRes RAW", "Optional"),
    (18, "Demand signal", "Sony FX6 / FX9", "XAVC; external RAW", "Optional"),
    (19, "Demand signal", "Canon C70 / C300 Mark III / C500 Mark II", "Cinema RAW Light / XF-AVC", "Optional"),
    (20, "Demand signal", "Z CAM E2 series", "ZRAW / ProRes / H.265", "Optional"),
]
SCHEMA = "rank int, status string, camera string, format string, sample string"


def cameras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAMERAS, SCHEMA)
