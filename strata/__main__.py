"""Show a document: ``python -m strata FILE`` prints its header, layers and what can't be read."""

import sys

from strata.sources import document


def main(path: str) -> int:
    with open(path, "rb") as f:
        t = document.read(path, f.read())
    d = t["documents"][0]
    if d["error"]:
        print(f"{path}: {d['error']}")
        return 1
    print(f"{path}: {d['width']} x {d['height']}, {d['channels']} channels of {d['depth']} bits, mode {d['mode']}, {d['hres']:g} dpi, {d['n_layers']} layers")
    for x in reversed(t["layers"]):
        print(f"{x['idx']:5d} {x['layer_type']:7s} {x['blend_key']} {x['opacity']:3d} ({x['rect_left']}, {x['rect_top']}, {x['rect_right']}, {x['rect_bottom']}) {x['name_unicode'] or ''}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1]))
