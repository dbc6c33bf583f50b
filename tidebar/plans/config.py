"""Timeframes, profiles, parameters and combos: the built-in configuration, loading another, resolving and checking it.

A configuration has three parts: ``profiles`` (name to instance keys),
``params`` (namespace, timeframe, instance key to ``id`` and parameters) and
``combos`` (namespace, combo to universe and the timeframe and profile of each
role).  ``resolve`` gives the instances that every (namespace, timeframe) needs:
the union over all combos that name it in any role, each key once, in the order
in which combos ask for them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from ..operators.registry import REGISTRY, Instance, validate

ROLES = ("lower", "middle", "upper")

#: Bars kept of each symbol.
WINDOWS = {
    ("stocks", "intraday_130m"): 300,
    ("stocks", "intraday_4h"): 250,
    ("stocks", "daily"): 260,
    ("stocks", "weekly"): 210,
    ("stocks", "monthly"): 250,
    ("stocks", "quarterly"): 200,
    ("stocks", "yearly"): 200,
    ("futures", "intraday_1h"): 16_000,
    ("futures", "intraday_4h"): 250,
    ("futures", "daily"): 260,
    ("futures", "weekly"): 210,
    ("futures", "monthly"): 250,
}

#: The coarser timeframes that are brought up to date after one.
CASCADE = {
    ("stocks", "intraday_130m"): ["daily", "weekly"],
    ("stocks", "intraday_4h"): ["daily", "weekly"],
    ("stocks", "daily"): ["weekly", "monthly"],
    ("stocks", "weekly"): ["monthly", "quarterly"],
    ("stocks", "monthly"): ["quarterly", "yearly"],
    ("futures", "intraday_1h"): ["intraday_4h", "daily"],
    ("futures", "intraday_4h"): ["daily", "weekly"],
    ("futures", "daily"): ["weekly", "monthly"],
}

#: Fixed values: (fast, intermediate, slow), percentile look-back, ratio length, mean length and shift, shift of MACD-V and squeeze.
GRID = {
    ("stocks", "intraday_130m"): ((6, 15, 30), 126, 30, (15, 1), 1),
    ("stocks", "intraday_4h"): ((6, 15, 30), 126, 30, (12, 1), 1),
    ("stocks", "daily"): ((5, 13, 21), 126, 21, (10, 0), 0),
    ("stocks", "weekly"): ((6, 13, 26), 104, 26, (13, 0), 0),
    ("stocks", "monthly"): ((6, 12, 24), 60, 24, (12, 1), 1),
    ("stocks", "quarterly"): ((5, 10, 20), 50, 20, (10, 1), 1),
    ("stocks", "yearly"): ((5, 10, 20), 50, 20, (10, 1), 1),
    ("futures", "intraday_1h"): ((7, 15, 23), 115, 23, (10, 1), 1),
    ("futures", "intraday_4h"): ((6, 15, 30), 126, 30, (12, 1), 1),
    ("futures", "daily"): ((5, 13, 21), 126, 21, (10, 1), 1),
    ("futures", "weekly"): ((6, 13, 26), 104, 26, (13, 1), 1),
    ("futures", "monthly"): ((6, 12, 24), 60, 24, (12, 1), 1),
}

#: What each role of a combo stores.
PROFILES = {
    "lower_core_v1": [
        "wyckoff_stage", "exh_abs_pa_current_bar", "exh_abs_pa_prior_bar", "sig_vol_current_bar", "sig_vol_prior_bar", "spy_qqq_vol_ma_ratio",
        "ma_trend_bullish", "ma_trend_bearish", "macdv_core_bull", "macdv_core_bear", "ttm_squeeze_pro",
    ],
    "middle_core_v1": ["wyckoff_stage", "exh_abs_pa_prior_bar", "macdv_guard", "sig_vol_current_bar", "spy_qqq_vol_ma_ratio"],
    "upper_core_v1": ["wyckoff_stage", "exh_abs_pa_prior_bar"],
}

#: Namespace, combo, universe, and the timeframes of the three roles.
_COMBOS = [
    ("stocks", "stocks_a_mqy_shortlist", "shortlist_stocks", "monthly", "quarterly", "yearly"),
    ("stocks", "stocks_a_mqy_all", "options_eligible", "monthly", "quarterly", "yearly"),
    ("stocks", "stocks_b_wmq_shortlist", "shortlist_stocks", "weekly", "monthly", "quarterly"),
    ("stocks", "stocks_b_wmq_all", "options_eligible", "weekly", "monthly", "quarterly"),
    ("stocks", "stocks_c_dwm_shortlist", "shortlist_stocks", "daily", "weekly", "monthly"),
    ("stocks", "stocks_c_dwm_all", "options_eligible", "daily", "weekly", "monthly"),
    ("stocks", "stocks_d_4hdw_shortlist", "shortlist_stocks", "intraday_4h", "daily", "weekly"),
    ("stocks", "stocks_d_130mdw_shortlist", "shortlist_stocks", "intraday_130m", "daily", "weekly"),
    ("futures", "futures_1_1h4hd_shortlist", "shortlist_futures", "intraday_1h", "intraday_4h", "daily"),
    ("futures", "futures_2_4hdw_shortlist", "shortlist_futures", "intraday_4h", "daily", "weekly"),
    ("futures", "futures_3_dwm_shortlist", "shortlist_futures", "daily", "weekly", "monthly"),
]
#: Other names of parameters that configuration files use.
ALIASES = {"fast_len": "fast", "int_len": "inter", "slow_len": "slow", "lookback_period": "lookback", "fast_length": "length"}
#: Parameters that say nothing here: the averages' source is always the fast length, and bars know their timeframe.
IGNORED = {"vma_length_source", "timeframe_name"}


@dataclass(frozen=True)
class Combo:
    name: str
    namespace: str
    lower: str
    middle: str
    upper: str
    universe: str

    def timeframes(self) -> tuple[str, str, str]:
        return self.lower, self.middle, self.upper


@dataclass(frozen=True)
class Config:
    """Resolved configuration: instances by (namespace, timeframe), and the combos."""

    instances: dict[tuple[str, str], list[Instance]]
    combos: list[Combo]
    windows: dict[tuple[str, str], int] = field(default_factory=lambda: dict(WINDOWS))

    def profile(self, namespace: str, timeframe: str) -> list[Instance]:
        return self.instances.get((namespace, timeframe), [])

    def universes(self, namespace: str, timeframe: str) -> list[str]:
        """The universes of all combos that use a timeframe in any role, in order of their names."""
        return sorted({c.universe for c in self.combos if c.namespace == namespace and timeframe in c.timeframes()})


def _grid_params() -> dict:
    out: dict = {}
    for (namespace, timeframe), ((fast, inter, slow), look, ratio, (length, displace), z) in GRID.items():
        trend = {"length": length, "displace": displace}
        out.setdefault(namespace, {})[timeframe] = {
            "wyckoff_stage": {"id": "wyckoff_stage", "fast": fast, "inter": inter, "slow": slow},
            "exh_abs_pa_current_bar": {"id": "exh_abs_price_action", "lookback": look, "z": 0},
            "exh_abs_pa_prior_bar": {"id": "exh_abs_price_action", "lookback": look, "z": 1},
            "sig_vol_current_bar": {"id": "significant_volume", "lookback": look, "z": 0},
            "sig_vol_prior_bar": {"id": "significant_volume", "lookback": look, "z": 1},
            "spy_qqq_vol_ma_ratio": {"id": "spy_qqq_volume_ma_ratio", "length": ratio},
            "ma_trend_bullish": {"id": "movingavg_trend_bullish"} | trend,
            "ma_trend_bearish": {"id": "movingavg_trend_bearish"} | trend,
            "macdv_core_bull": {"id": "macdv_core_bullish", "z": z},
            "macdv_core_bear": {"id": "macdv_core_bearish", "z": z},
            "macdv_guard": {"id": "macdv_guard", "z": 0},
            "ttm_squeeze_pro": {"id": "ttm_squeeze_pro", "z": z},
        }
    return out


def _combo_params() -> dict:
    out: dict = {}
    for namespace, name, universe, *timeframes in _COMBOS:
        roles = {f"{r}_tf": t for r, t in zip(ROLES, timeframes, strict=True)} | {f"{r}_profile": f"{r}_core_v1" for r in ROLES}
        out.setdefault(namespace, {})[name] = {"universe": universe} | roles
    return out


def resolve(profiles: dict, params: dict, combos: dict, windows: dict | None = None) -> Config:
    """Check a configuration and say what each (namespace, timeframe) needs.

    Unknown profiles, timeframes without parameters, keys without parameters,
    parameters without an id, unknown ids and unknown or missing parameters are
    errors, before any plan is built.
    """
    instances: dict[tuple[str, str], dict[str, Instance]] = {}
    found = []
    for namespace, by_tf in params.items():
        for timeframe, keys in by_tf.items():
            for key, given in keys.items():
                if given.get("id") is None:
                    raise ValueError(f"{namespace}/{timeframe}/{key} has no id")
    for namespace, by_name in combos.items():
        for name, cfg in by_name.items():
            if not isinstance(cfg, dict):
                continue
            for role in ROLES:
                timeframe, profile = cfg.get(f"{role}_tf"), cfg.get(f"{role}_profile")
                if not timeframe or not profile:
                    continue
                if profile not in profiles:
                    raise ValueError(f"{namespace}/{name}: unknown profile {profile}")
                known = params.get(namespace, {}).get(timeframe)
                if not known:
                    raise ValueError(f"no parameters for {namespace}/{timeframe}")
                held = instances.setdefault((namespace, timeframe), {})
                for key in profiles[profile]:
                    if key in held:
                        continue
                    if key not in known:
                        raise ValueError(f"no parameters for {namespace}/{timeframe}/{key}")
                    if known[key]["id"] not in REGISTRY:
                        raise ValueError(f"unknown indicator {known[key]['id']} of {namespace}/{timeframe}/{key}")
                    held[key] = Instance(key, known[key]["id"], {ALIASES.get(k, k): v for k, v in known[key].items() if k != "id" and k not in IGNORED})
            found.append(Combo(name, namespace, *(cfg.get(f"{r}_tf") for r in ROLES), cfg.get("universe")))
    for held in instances.values():
        validate(list(held.values()))
    return Config({k: list(v.values()) for k, v in instances.items()}, found, dict(WINDOWS) if windows is None else windows)


def _file(folder: Path, name: str) -> dict:
    """``name``.json, or ``name``.yaml where a YAML reader is installed."""
    path = folder / f"{name}.json"
    if path.exists():
        return json.loads(path.read_text(encoding="utf-8"))
    import yaml

    return yaml.safe_load((folder / f"{name}.yaml").read_text(encoding="utf-8")) or {}


def load(folder: str) -> Config:
    """A configuration folder on the driver: indicator_profiles, indicator_params, multi_timeframe_combos and timeframes."""
    at = Path(folder)
    windows = {(ns, tf): int(cfg["window_bars"]) for ns, by_tf in _file(at, "timeframes").items() for tf, cfg in by_tf.items()}
    return resolve(_file(at, "indicator_profiles").get("profiles", {}), _file(at, "indicator_params").get("indicators", {}), _file(at, "multi_timeframe_combos"), windows)


DEFAULT = resolve(PROFILES, _grid_params(), _combo_params())


def profile(namespace: str, timeframe: str) -> list[Instance]:
    """The instances of the built-in configuration."""
    return DEFAULT.profile(namespace, timeframe)
