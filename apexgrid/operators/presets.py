"""Ready-made computed channels."""

from __future__ import annotations

from apexgrid.functions.channel import ch, derivative, fn, integrate, smooth
from apexgrid.operators.computed import Definition

# fixed values
GRAVITY = 9.81
WHEELBASE_M = 2.5
KMH_PER_MS = 3.6
THROTTLE_WINDOW = 10


def wheel_slip(corner: str) -> Definition:
    """Wheel speed against GPS speed in percent."""
    speed = ch("GPS_Speed")
    slip = (ch(f"WheelSpeed_{corner}") - speed) / fn("max", speed, 1) * 100
    return Definition(f"Wheel Slip {corner}", slip, "%", category="Traction")


def lean_angle(name: str, force: str) -> Definition:
    angle = fn("rad_to_deg", fn("atan2", ch(force), GRAVITY))
    return Definition(name, angle, "deg", category="Chassis")


def presets() -> list[Definition]:
    """All presets, under the logger's channel names."""
    speed = ch("GPS_Speed")
    total_force = fn("sqrt", fn("pow", ch("G_Force_Lat"), 2) + fn("pow", ch("G_Force_Long"), 2))
    yaw = fn("rad_to_deg", fn("atan2", ch("Yaw_Rate") * WHEELBASE_M, fn("max", speed, 1)))
    return [
        wheel_slip("FL"),
        wheel_slip("FR"),
        wheel_slip("RL"),
        wheel_slip("RR"),
        lean_angle("Pitch Angle", "G_Force_Long"),
        lean_angle("Roll Angle", "G_Force_Lat"),
        Definition("Total G-Force", total_force, "G", category="Chassis"),
        Definition("Oversteer Angle", yaw - ch("Steering_Angle"), "deg", category="Handling"),
        Definition("Steering Rate", derivative(ch("Steering_Angle")), "deg/s", category="Handling"),
        Definition(
            "Throttle Smoothed", smooth(ch("Throttle_Pos"), THROTTLE_WINDOW), "%", category="Engine"
        ),
        Definition("Speed Delta", derivative(speed), "km/h/s", category="Performance"),
        Definition("Distance", integrate(speed / KMH_PER_MS), "m", category="Performance"),
    ]


PRESET_NAMES = [
    "Wheel Slip FL",
    "Wheel Slip FR",
    "Wheel Slip RL",
    "Wheel Slip RR",
    "Pitch Angle",
    "Roll Angle",
    "Total G-Force",
    "Oversteer Angle",
    "Steering Rate",
    "Throttle Smoothed",
    "Speed Delta",
    "Distance",
]


def preset(name: str) -> Definition:
    return next(d for d in presets() if d.name == name)
