"""Page types from categories: normalisation and ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories that serve maintenance (fixed values).
MAINTENANCE = (
    "?", "stub", "Stub", "Upcoming", "Verify", "Information needed", "Citation needed", "Articles to be expanded", "Articles needing rewrite", "Article cleanup", "Testing needed",
    "Cleanup without a reason", "Pending split", "Pending merge", "Current split", "In development", "Check version", "Verify current information",
)
MAINTENANCE_STARTS = (
    "Pages with", "Pages using", "Pages needing", "Unknown ", "Java Edition upcoming", "Bedrock Edition upcoming", "Java Edition specific", "Bedrock Edition specific", "Minecraft Education specific",
    "In development Java", "In development Bedrock", "Missing discussion", "Minecraft Work in progress", "Asset history", "Verify for", "Verify changelog", "Resources with invalid",
)
MAINTENANCE_ENDS = ("version history", "upcoming tag")
#: Page types in order, with the categories that set them (fixed values).
TYPE_RULES = (
    ("mob", ("Hostile mobs", "Passive mobs", "Neutral mobs", "Boss mobs", "Monster mobs", "Undead mobs", "Golem mobs", "Humanoid mobs", "Aquatic mobs", "Animal mobs", "Tameable mobs", "Flying mobs", "End mobs", "Removed mobs", "Joke mobs")),
    ("block", ("Blocks", "Natural blocks", "Manufactured blocks", "Generated structure blocks", "Technical blocks", "Non-solid blocks", "Utility blocks", "Redstone")),
    ("item", ("Items", "Food", "Combat", "Drinks", "Potions", "Non-stackable resources", "Stackable resources", "Renewable resources")),
    ("biome", ("Biomes",)),
    ("structure", ("Generated structures", "World features")),
    ("dimension", ("Dimensions",)),
    ("enchantment", ("Enchantments",)),
    ("effect", ("Effects",)),
    ("mechanic", ("Gameplay", "User interface", "Commands", "Trading", "Achievements", "Advancements")),
    ("entity", ("Entities", "Stationary entities", "Playable entities", "Players", "NPCs", "Characters", "Paintings")),
    ("version", ("Java Edition versions", "Bedrock Edition versions", "Snapshots", "Pre-releases", "Release candidates", "Version disambiguation pages", "Named updates", "Java Edition", "Bedrock Edition")),
    ("tutorial", ("Tutorials",)),
    ("franchise", ("Minecraft (franchise)", "Games", "Minecraft Dungeons", "Minecraft Legends", "Minecraft Earth", "Minecraft Education", "LEGO", "Merchandise", "Collaborations")),
    ("media", ("Music", "Soundtracks", "Books", "Online content", "Animated content", "Game trailers", "Resource packs", "Textures", "Texture atlases", "DLC promotions")),
    ("disambiguation", ("Disambiguation pages", "Set index pages")),
    ("redirect", ("Soft redirects",)),
)


def is_maintenance(category: Column) -> Column:
    out = category.isin(*MAINTENANCE)
    for p in MAINTENANCE_STARTS:
        out = out | category.startswith(p)
    for p in MAINTENANCE_ENDS:
        out = out | category.endswith(p)
    return out


def semantic(categories: Column) -> Column:
    """Trimmed, without empty and maintenance ones, each once, in order."""
    return F.array_distinct(F.filter(F.transform(categories, lambda c: F.trim(c)), lambda c: (c != "") & ~is_maintenance(c)))


def page_type(categories: Column, rules=TYPE_RULES) -> Column:
    """The first rule that shares a category; else other."""
    out = None
    for name, triggers in rules:
        hit = F.arrays_overlap(categories, F.array(*[F.lit(t) for t in triggers]))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def classified(pages: DataFrame, categories: str, rules=TYPE_RULES) -> DataFrame:
    """Adds semantic_categories and page_type."""
    return pages.withColumn("semantic_categories", semantic(F.col(categories))).withColumn("page_type", page_type(F.col("semantic_categories"), rules))


def type_counts(classified_pages: DataFrame) -> DataFrame:
    return classified_pages.groupBy("page_type").agg(F.count("*").alias("n"))
