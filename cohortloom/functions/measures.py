"""Premium, value and quality measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom.functions import codes
from cohortloom.functions.bands import first_match, flag
from cohortloom.functions.calendar import whole_years


def status_flags(status: Column) -> dict[str, Column]:
    """One 0/1 column per status meaning."""
    return {f"f_{name}_ind": flag(status.isin(*members)) for name, members in codes.STATUS_CODES.items()}


def annualised_premium(premium: Column, mode: Column, status: Column) -> Column:
    """Premium over a year; 0 for a policy that never came into force."""
    months = mode.try_cast("int")
    return F.when(status.isin(*codes.VOID_CODES), F.lit(0.0)).otherwise(F.try_divide(premium * 12, months))


def adjusted_premium(days_in_force: Column, mode: Column, premium: Column, ape: Column,
                     single_premium: Column) -> Column:
    """Annualised premium corrected for early termination.

    Up to 21 days count nothing; a full year or no termination counts in full; in between a
    modal policy counts the instalments it reached. A single premium counts a tenth.
    """
    months = mode.try_cast("int")
    short = days_in_force <= 21

    def reached(days_per_instalment: int) -> Column:
        return premium * (F.floor(days_in_force / days_per_instalment) + 1)

    regular = first_match([
        (days_in_force.isNull(), ape),
        (short, 0.0),
        ((days_in_force >= 365) | (months == 12), ape),
        (months == 1, reached(31)),
        (months == 3, reached(92)),
        (months == 6, reached(183)),
    ], 0.0)
    single = F.when(days_in_force.isNull() | short, F.lit(0.0)).otherwise(premium * 0.1)
    return F.coalesce(F.when(single_premium == 1, single).otherwise(regular), F.lit(0.0))


def premium_years(effective: Column, snapshot: Column, duration: Column) -> tuple[Column, Column]:
    """Years already paid (never more than the premium term) and years still to pay."""
    paid = F.least(whole_years(effective, snapshot), duration.cast("int"))
    return paid, duration.cast("int") - paid


def decimal_sum(column: Column) -> Column:
    """A sum of amounts as a decimal, so it is the same in any order of the rows."""
    return F.sum(column.cast("decimal(28,8)"))


def exact_sum(column: Column) -> Column:
    """``decimal_sum`` as a double."""
    return decimal_sum(column).cast("double")


def exact_mean(column: Column) -> Column:
    return F.try_divide(exact_sum(column), F.count(column))


def lapse_adjusted(value: Column, *scores: Column) -> Column:
    """Value weighted by the chance to stay, from the first known lapse score."""
    return value * (F.lit(1.0) - F.coalesce(*scores, F.lit(0.0)))


def relation(is_owner: Column, age_gap: Column, owner_gender: Column, insured_gender: Column) -> Column:
    """Estimated relation of the insured to the owner from the age gap and genders."""
    return first_match([
        ((is_owner == 1) | age_gap.isNull(), "self"),
        (age_gap.between(18, 40), "child"),
        (age_gap > 40, "others"),
        (age_gap < -17, "parent"),
        (~owner_gender.eqNullSafe(insured_gender), "spouse"),
    ], "others")


def ratio_or_one(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, 1 for a zero denominator."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(1.0))


def kept_rate(bad: Column, every: Column) -> Column:
    """Share without the bad outcome; 1 when there is nothing to judge."""
    return F.when(every != 0, F.lit(1.0) - bad / every).otherwise(F.lit(1.0))


def vip_flags(total_ape: Column, ten_year_policies: Column) -> dict[str, Column]:
    bound = codes.VIP_BOUNDS
    return {
        "f_vip_elite": flag(total_ape >= bound["elite"]),
        "f_vip_plat": flag((total_ape >= bound["plat"]) & (total_ape < bound["elite"])),
        "f_vip_gold": flag((total_ape >= bound["gold"]) & (total_ape < bound["plat"])),
        "f_vip_silver": flag(
            (total_ape >= bound["silver"]) & (total_ape < bound["gold"]) & (ten_year_policies >= 1)
        ),
    }


def channel_margin(location: Column, channel: Column, margins: dict[str, Column],
                   location_prefixes: dict[str, str]) -> Column:
    """Margin by place of sale.

    ``margins`` has the families agency, direct, banca, affinity, other and one entry per
    location family; ``location_prefixes`` maps a location prefix to its family.
    """
    no_location = first_match([
        (channel.isin(*codes.CHANNEL_CODES["banca"]), margins["banca"]),
        (channel.isin(*codes.CHANNEL_CODES["affinity"]), margins["affinity"]),
        (channel.isin(*codes.CHANNEL_CODES["agency"]), margins["agency"]),
        (channel.isin(*codes.CHANNEL_CODES["direct"]), margins["direct"]),
        (channel == codes.FIXED_MARGIN_CODE, F.lit(codes.FIXED_MARGIN)),
    ], margins["other"])
    return first_match(
        [(location.isNull(), no_location), (channel == "*", margins["agency"])]
        + [(location.startswith(prefix), margins[family]) for prefix, family in location_prefixes.items()],
        margins["other"],
    )


def sales_channel(channel: Column, office: Column) -> Column:
    return first_match([
        (channel.isin(*codes.CHANNEL_CODES["agency"]), "Agency"),
        (channel.isin(*codes.CHANNEL_CODES["direct"]), "DMTM"),
    ], office)
