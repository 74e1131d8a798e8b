"""Kernel and map specifications. A specification is a value: nothing is global."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Names that users of kernel libraries know, and what they stand for.
KERNELS = (
    "gaussian", "maternnorm", "materntensor", "tensornorm", "absnorm", "multiquadricnorm", "multiquadrictensor",
    "sincardtensor", "sincardsquaretensor", "dotproduct", "scalar_product", "gaussianper", "linear_regressor",
)
KERNEL_ALIASES = {
    "matern": "materntensor", "DotProduct": "dotproduct", "scalarproduct": "scalar_product", "linear": "linear_regressor",
    "multiquadric": "multiquadricnorm", "tensor": "tensornorm", "periodicgaussian": "gaussianper",
}
MAPS = (
    "linear_map", "affine_map", "log", "exp", "scale_std", "scale_factor", "scale_to_unitcube", "scale_to_erf",
    "scale_to_erfinv", "scale_to_mean_distance", "scale_to_min_distance", "map_to_grid",
)
#: Named chains, applied left to right: unit cube first, inverse error function second, distances last.
MAP_CHAINS = {
    "standardmean": ("scale_to_unitcube", "scale_to_erfinv", "scale_to_mean_distance"),
    "standardmin": ("scale_to_unitcube", "scale_to_erfinv", "scale_to_min_distance"),
    "unitcube": ("scale_to_unitcube",),
    "unitcubemin": ("scale_to_unitcube", "scale_to_min_distance"),
    "unitcubemean": ("scale_to_unitcube", "scale_to_mean_distance"),
    "unitcubeerfinv": ("scale_to_unitcube", "scale_to_erfinv"),
    "meandistance": ("scale_to_mean_distance",),
    "mindistance": ("scale_to_min_distance",),
    "std": ("scale_std",),
    "grid": ("map_to_grid",),
    "bandwidth": ("scale_factor",),
}
FITTED_MAPS = frozenset({"scale_std", "scale_to_unitcube", "scale_to_mean_distance", "scale_to_min_distance", "map_to_grid"})
DEFAULT_MAPS = {
    "maternnorm": "meandistance", "multiquadricnorm": "standardmean", "multiquadrictensor": "standardmin",
    "sincardtensor": "mindistance", "sincardsquaretensor": "mindistance",
}


#: A kernel given as functions: params k(x, y) on blocks, and grad(x, y) if known.
USER = "user"


def kernel_name(name: str) -> str:
    found = KERNEL_ALIASES.get(name, name)
    if found not in (*KERNELS, USER):
        raise NameError(f"unknown kernel {name!r}; known: {', '.join(KERNELS)}")
    return found


def map_names(names: str | tuple[str, ...] | list[str] | None) -> tuple[str, ...]:
    """Names or chains, resolved to single maps in order of application."""
    if not names:
        return ()
    out: list[str] = []
    for n in (names,) if isinstance(names, str) else names:
        found = MAP_CHAINS.get(n, (n,))
        if any(f not in MAPS for f in found):
            raise NameError(f"unknown map {n!r}; known: {', '.join((*MAPS, *MAP_CHAINS))}")
        out += found
    return tuple(out)


def requires_fit(name: str) -> bool:
    return any(n in FITTED_MAPS for n in map_names(name))


def requires_bandwidth(name: str) -> bool:
    return name == "bandwidth"


@dataclass(frozen=True)
class KernelSpec:
    """A kernel by name, its maps, polynomial order (None or 0: none beyond the
    kernel), regularisation, and parameters of kernel and maps."""

    name: str = "maternnorm"
    maps: tuple[str, ...] | str | None = None
    order: int = 0
    reg: float = 1e-8
    params: dict = field(default_factory=dict, hash=False)
    factors: tuple["KernelSpec", ...] = ()
    split: int = 0

    def __post_init__(self):
        if not self.factors:
            object.__setattr__(self, "name", kernel_name(self.name))
        object.__setattr__(self, "maps", map_names(self.maps))

    @classmethod
    def default(cls, name: str, **more) -> "KernelSpec":
        """With the kernel's customary map."""
        return cls(name, DEFAULT_MAPS.get(kernel_name(name)), **more)

    def product(self, other: "KernelSpec", split: int) -> "KernelSpec":
        """k1 on the first split features times k2 on the rest."""
        return KernelSpec("product", None, 0, max(self.reg, other.reg), {}, (self, other), split)

    __and__ = lambda self, other: self.product(other, self.params.get("dim", 1))

    def with_maps(self, *names: str) -> "KernelSpec":
        return replace(self, maps=(*self.maps, *map_names(names)))

    def with_order(self, order: int) -> "KernelSpec":
        return replace(self, order=order)

    def with_reg(self, reg: float) -> "KernelSpec":
        return replace(self, reg=reg)
