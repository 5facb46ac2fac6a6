"""Lists, factors and ranges the results depend on.

Nothing here is computed; these are the published business constants of the
delivery data set, kept as plain text so they can be read and compared.
"""

from decimal import Decimal as D

# The six vehicle classes.
# type, payload lbs, cargo cuft, max stops, usual fuel, $ per mile, $ per day
VEHICLE_TYPES = [
    ("sprinter_van", 3500, 350, 25, "diesel", D("0.42"), D("125.00")),
    ("box_truck", 8000, 800, 18, "diesel", D("0.68"), D("195.00")),
    ("26ft_truck", 12000, 1500, 12, "diesel", D("0.85"), D("275.00")),
    ("cargo_van", 2800, 280, 30, "gasoline", D("0.38"), D("95.00")),
    ("refrigerated_van", 4000, 300, 20, "diesel", D("0.72"), D("225.00")),
    ("flatbed", 15000, 2000, 8, "diesel", D("0.95"), D("310.00")),
]

# A vehicle's own figures lie within so many percent of its class's; of ten
# vehicles, so many run on another fuel than their class.
VEHICLE_SPREAD = 10
OWN_FUELS = [("electric", 2), ("hybrid", 1)]

# Allowed values of the categorical columns.
VEHICLE_STATUSES = ["active", "maintenance", "retired"]
FUEL_TYPES = ["diesel", "gasoline", "electric", "hybrid"]
ORDER_STATUSES = ["delivered", "in_transit", "pending", "cancelled", "returned"]
PRIORITIES = ["standard", "priority", "express"]
STOP_STATUSES = ["completed", "attempted", "rescheduled", "skipped"]
DELAY_REASONS = [
    "traffic",
    "customer_not_available",
    "access_issue",
    "weather",
    "vehicle_breakdown",
]
METHODS = ["manual_dispatch", "or_tools_cvrp", "greedy_nearest"]

# Cost per stop and minutes per planned mile.
STOP_COST_USD = D("3.50")
MINUTES_PER_MILE = D("1.2")

# Demand factor per month, per day of week (1 = Sunday) and per
# depot class; months and days not listed count 1.0.
MONTH_FACTORS = {
    1: D("0.7"),
    6: D("0.85"),
    7: D("0.85"),
    8: D("1.3"),
    11: D("1.6"),
    12: D("1.6"),
}
WEEKDAY_FACTORS = {1: D("0.10"), 2: D("1.15"), 6: D("0.90"), 7: D("0.35")}
DEPOT_CLASS_FACTORS = {"busy": D("1.5"), "regular": D("1.1"), "small": D("0.7")}

# Our own choice: source order codes -> mart values.
PRIORITY_CODES = {"1-URGENT": "express", "2-HIGH": "priority"}
STATUS_CODES = {"F": "delivered", "O": "in_transit", "P": "pending"}

# Our own choice: sampling rate per source priority, used by the sampling query.
PRIORITY_RATES = {
    "1-URGENT": D("0.9"),
    "2-HIGH": D("0.6"),
    "3-MEDIUM": D("0.3"),
    "4-NOT SPECIFIED": D("0.15"),
    "5-LOW": D("0.05"),
}

# Our own choice: how the source columns are read as deliveries.
# days from order to requested delivery per source priority, and for any other
PROMISE_DAYS = {"1-URGENT": 5, "2-HIGH": 10, "3-MEDIUM": 20}
PROMISE_DAYS_ELSE = 30
# delivery window in minutes after midnight per source priority, and for any other
WINDOWS = {"1-URGENT": (420, 720), "2-HIGH": (480, 840), "3-MEDIUM": (540, 1020)}
WINDOW_ELSE = (600, 1140)
# the order data run over years, a delivery day over minutes: days overdue for a minute of delay
DAYS_PER_DELAY_MINUTE = 30
# outcome of a stop and cause of a delay per (return flag, line status)
OUTCOMES = {
    ("N", "F"): "completed",
    ("N", "O"): "completed",
    ("A", "F"): "completed",
    ("A", "O"): "attempted",
    ("R", "F"): "rescheduled",
    ("R", "O"): "skipped",
}
REASONS = {
    ("N", "F"): "traffic",
    ("N", "O"): "weather",
    ("A", "F"): "access_issue",
    ("A", "O"): "customer_not_available",
    ("R", "F"): "vehicle_breakdown",
    ("R", "O"): "customer_not_available",
}
# pounds and cubic feet of one ordered unit for each step of the part's size
LBS_PER_SIZE = D("0.2")
CUFT_PER_SIZE = D("0.02")
# planned minutes at a stop; real minutes: a fixed part and one for so many units
STOP_MINUTES = 6
SERVICE_MINUTES = 3
UNITS_PER_MINUTE = 5
# part of a line's charge (price, less discount, plus tax) that its delivery costs
FREIGHT_SHARE = D("0.005")
# most stops of a route laid out by hand, and by the nearest-stop rule
MANUAL_STOPS = 5
GREEDY_STOPS = 10
# account balances under which a vehicle counts as retired, or in maintenance
RETIRED_BELOW = -500
MAINTENANCE_BELOW = 0
