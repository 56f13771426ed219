from cartsight.functions.columns import (
    delay_category,
    delay_days,
    delay_seconds,
    distance_band,
    amount,
    exact_mean,
    exact_sum,
    haversine_km,
    joined_limbs,
    limb_names,
    limb_sums,
    limbs,
    merged_limbs,
    month_index,
    order_key,
    percent_of,
    rounded_delay,
    rounded_km,
    tile_key,
    tile_steps,
)

__all__ = [
    "delay_category",
    "delay_days",
    "delay_seconds",
    "distance_band",
    "amount",
    "exact_mean",
    "exact_sum",
    "haversine_km",
    "joined_limbs",
    "limb_names",
    "limb_sums",
    "limbs",
    "merged_limbs",
    "month_index",
    "order_key",
    "percent_of",
    "rounded_delay",
    "rounded_km",
    "tile_key",
    "tile_steps",
]
