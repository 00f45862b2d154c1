"""The tools of the car assistant: their parameters, comparators, values and phrases, as Python data and as Spark data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Param:
    name: str
    type: str
    enum: tuple[str, ...] = ()
    minimum: float | None = None
    maximum: float | None = None
    min_length: int | None = None
    description: str | None = None


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    params: tuple[Param, ...] = ()
    required: tuple[str, ...] = field(default=())


# Names, bounds, choices and descriptions of the tools.
TOOLS: tuple[Tool, ...] = (
    Tool(
        "set_climate",
        "Bật/tắt và chỉnh điều hoà.",
        (
            Param("power", "string", enum=("on", "off"), description="mặc định on"),
            Param("temperature", "number", minimum=16, maximum=30, description="độ C"),
            Param("zone", "string", enum=("driver", "passenger", "all")),
            Param("mode", "string", enum=("auto", "cool", "heat")),
        ),
    ),
    Tool("set_fan_speed", "Chỉnh mức gió điều hoà.", (Param("level", "integer", minimum=1, maximum=7),), ("level",)),
    Tool(
        "navigate_to",
        "Dẫn đường tới một địa điểm.",
        (Param("destination", "string", min_length=1), Param("avoid_tolls", "boolean", description="tránh trạm thu phí")),
        ("destination",),
    ),
    Tool(
        "find_charging_station",
        "Tìm trạm sạc gần nhất.",
        (Param("max_distance_km", "integer", minimum=1, maximum=100), Param("fast_only", "boolean", description="chỉ trạm sạc nhanh")),
    ),
    Tool("play_music", "Phát nhạc/podcast. Không có query thì phát tiếp.", (Param("query", "string", min_length=1, description="tên bài, ca sĩ, thể loại"),)),
    Tool("set_volume", "Chỉnh âm lượng loa.", (Param("level", "integer", minimum=0, maximum=30),), ("level",)),
    Tool("call_contact", "Gọi điện cho người trong danh bạ.", (Param("name", "string", min_length=1),), ("name",)),
    Tool("read_messages", "Đọc tin nhắn mới.", (Param("count", "integer", minimum=1, maximum=10),)),
    Tool("get_vehicle_status", "Xem thông tin xe.", (Param("field", "string", enum=("battery", "range", "tire_pressure", "odometer")),), ("field",)),
    Tool(
        "open_window",
        "Mở/đóng cửa sổ. percent=0 là đóng hẳn, mặc định 100.",
        (Param("position", "string", enum=("driver", "passenger", "rear_left", "rear_right", "all")), Param("percent", "integer", minimum=0, maximum=100)),
        ("position",),
    ),
    Tool("lock_doors", "Khoá tất cả cửa."),
    Tool("unlock_doors", "Mở khoá tất cả cửa."),
    Tool("set_lights", "Chỉnh đèn pha.", (Param("mode", "string", enum=("off", "auto", "low", "high"), description="low=cốt, high=pha"),), ("mode",)),
    Tool("set_drive_mode", "Đổi chế độ lái.", (Param("mode", "string", enum=("eco", "comfort", "sport")),), ("mode",)),
    Tool(
        "set_reminder",
        "Hẹn giờ nhắc việc.",
        (Param("text", "string", min_length=1), Param("minutes", "integer", minimum=1, maximum=1440, description="nhắc sau bao nhiêu phút")),
        ("text", "minutes"),
    ),
    Tool("lookup_traffic_law", "Tra luật giao thông Việt Nam (mức phạt, quy định).", (Param("question", "string", min_length=1),), ("question",)),
    Tool("lookup_sign", "Tra ý nghĩa biển báo theo số hiệu, vd P.102, W.207a.", (Param("code", "string", min_length=1),), ("code",)),
)
# Parameters compared as free text and as names, and values that equal an absent parameter.
FREE_TEXT = (("lookup_traffic_law", "question"), ("set_reminder", "text"))
NAMES = (("navigate_to", "destination"), ("play_music", "query"))
DEFAULTS = {("set_climate", "power"): "on", ("open_window", "percent"): 100}

# Pools that slot values are drawn from.
DESTINATIONS = (
    "Hồ Gươm", "sân bay Nội Bài", "sân bay Tân Sơn Nhất", "chợ Bến Thành", "Landmark 81", "bệnh viện Bạch Mai", "Times City",
    "Vincom Bà Triệu", "phố cổ Hội An", "cầu Rồng", "Đại học Bách khoa Hà Nội", "nhà thờ Đức Bà", "Hồ Tây", "bến xe Mỹ Đình",
    "Aeon Mall Long Biên", "công viên Thống Nhất", "chợ Đồng Xuân", "Ocean Park", "Phú Mỹ Hưng", "Thảo Cầm Viên", "Royal City",
    "biển Mỹ Khê", "đèo Hải Vân", "số 5 Lê Duẩn", "nhà", "công ty", "trường Tiểu học Kim Đồng", "bệnh viện Chợ Rẫy", "Bà Nà Hills",
    "Nhà hát Lớn", "sân Mỹ Đình", "Hồ Con Rùa",
)
CONTACTS = (
    "mẹ", "bố", "vợ", "chồng", "anh Tuấn", "chị Lan", "sếp Hùng", "Minh", "bà nội", "cô Hạnh", "anh Khoa", "Trang", "em Ngọc",
    "chú Ba", "Quang Huy", "chị Thảo", "thầy Nam", "Phương Anh",
)
MUSIC = (
    "Sơn Tùng", "nhạc Trịnh", "Lạc Trôi", "nhạc không lời", "bolero", "Đen Vâu", "nhạc lofi", "Hà Anh Tuấn", "nhạc thiếu nhi",
    "podcast tin tức", "Mỹ Tâm", "Chúng Ta Của Hiện Tại", "nhạc EDM", "nhạc xưa", "Hoàng Thùy Linh", "nhạc Hàn", "Taylor Swift",
    "nhạc rap Việt",
)
REMINDERS = (
    "mua sữa cho con", "gọi lại cho khách", "sạc xe", "đón con ở trường", "uống thuốc", "họp với team", "lấy đồ giặt",
    "đóng tiền điện", "nghỉ chân cho đỡ mỏi", "mua hoa cho vợ", "gửi báo cáo cho sếp", "ghé tiệm thuốc", "rút tiền",
    "đặt bánh sinh nhật",
)
MINUTES = (5, 10, 15, 20, 30, 45, 60, 90, 120)
SIGN_CODES = (
    "P.102", "P.103a", "P.106a", "P.123a", "P.124a", "P.127", "P.130", "P.131a", "R.302a", "R.303", "R.411", "R.434", "W.201a",
    "W.207b", "W.224", "W.245a", "I.408", "I.423b",
)
LAW_TOPICS = (
    "xe máy vượt đèn đỏ phạt bao nhiêu", "ô tô không thắt dây an toàn bị phạt thế nào", "uống bia rồi lái ô tô bị phạt gì",
    "đi vào làn khẩn cấp trên cao tốc", "quên mang bằng lái", "dùng điện thoại khi đang lái xe", "chạy quá tốc độ 15 km/h",
    "đỗ ô tô trên vỉa hè", "đi ngược chiều", "quay đầu xe ở nơi có biển cấm quay đầu", "trẻ em dưới 10 tuổi ngồi ghế trước ô tô",
    "không nhường đường xe cứu thương", "bấm còi trong khu dân cư ban đêm", "bị trừ điểm bằng lái", "tốc độ tối đa trong khu dân cư",
    "dừng xe trên cao tốc", "lùi xe trên cao tốc", "vượt bên phải", "chuyển làn không bật xi nhan", "đi sai làn đường",
    "không có bảo hiểm xe", "chở quá số người",
)
CHITCHAT_TOPICS = (
    "chào hỏi trợ lý buổi sáng", "hỏi trợ lý tên gì", "nhờ kể một câu chuyện cười", "khen trợ lý giỏi", "hỏi thời tiết ngày mai",
    "nhờ đặt vé máy bay", "hỏi giá vàng hôm nay", "than mệt vì kẹt xe", "hỏi cách nấu phở", "cảm ơn trợ lý",
    "hỏi đội bóng nào vô địch năm nay", "nhờ đặt bàn nhà hàng", "hỏi trợ lý có biết hát không", "kể là hôm nay sinh nhật mình",
    "hỏi nên ăn trưa món gì",
)

# Ways to say a parameter's value; the first describes it in instructions.
ALIASES: dict[tuple[str, str], dict[object, tuple[str, ...]]] = {
    ("set_climate", "power"): {"on": ("bật", "mở", "on"), "off": ("tắt", "off", "ngắt")},
    ("set_climate", "zone"): {
        "driver": ("ghế lái", "bên lái", "tài xế", "tài", "driver"),
        "passenger": ("ghế phụ", "bên phụ", "phụ", "passenger", "bên cạnh"),
        "all": ("cả xe", "tất cả", "toàn bộ", "cả hai", "all", "hết", "mọi"),
    },
    ("set_climate", "mode"): {"auto": ("tự động", "auto"), "cool": ("làm mát", "mát", "lạnh", "cool"), "heat": ("sưởi", "ấm", "nóng", "heat")},
    ("get_vehicle_status", "field"): {
        "battery": ("pin", "battery", "phần trăm"),
        "range": ("quãng đường còn đi được", "đi được", "quãng đường", "range", "bao xa", "bao nhiêu km", "bao nhiêu cây", "chạy được"),
        "tire_pressure": ("áp suất lốp", "lốp", "bánh", "tire", "vỏ xe"),
        "odometer": ("số km đã chạy", "odo", "đã chạy", "công tơ", "tổng"),
    },
    ("open_window", "position"): {
        "driver": ("cửa sổ ghế lái", "ghế lái", "bên lái", "tài", "driver", "lái"),
        "passenger": ("cửa sổ ghế phụ", "ghế phụ", "bên phụ", "phụ", "passenger"),
        "rear_left": ("cửa sổ sau bên trái", "sau bên trái", "sau trái", "trái phía sau", "phía sau bên trái", "rear left", "sau ben trai"),
        "rear_right": ("cửa sổ sau bên phải", "sau bên phải", "sau phải", "phải phía sau", "phía sau bên phải", "rear right"),
        "all": ("tất cả cửa sổ", "tất cả", "hết", "cả", "toàn bộ", "all", "4 cửa", "bốn cửa", "các cửa"),
    },
    ("set_lights", "mode"): {
        "off": ("tắt đèn", "tắt", "off"),
        "auto": ("tự động", "auto"),
        "low": ("đèn cốt", "cốt", "chiếu gần", "gần", "low"),
        "high": ("đèn pha", "pha", "chiếu xa", "xa", "high"),
    },
    ("set_drive_mode", "mode"): {"eco": ("eco", "tiết kiệm"), "comfort": ("comfort", "thoải mái", "tiêu chuẩn", "bình thường", "normal"), "sport": ("sport", "thể thao")},
    ("navigate_to", "avoid_tolls"): {True: ("tránh trạm thu phí", "phí", "bot", "toll", "trạm")},
    ("find_charging_station", "fast_only"): {True: ("chỉ trạm sạc nhanh", "nhanh", "fast", "dc")},
}
NUMBER_ALIASES: dict[tuple[str, str], dict[int, tuple[str, ...]]] = {
    ("open_window", "percent"): {0: ("đóng", "kéo lên", "close"), 50: ("một nửa", "nửa"), 100: ("hết", "toàn bộ", "hoàn toàn")},
    ("set_reminder", "minutes"): {30: ("nửa tiếng",), 60: ("một tiếng", "1 tiếng", "1 giờ", "một giờ"), 90: ("tiếng rưỡi",), 120: ("hai tiếng", "2 tiếng", "2 giờ", "hai giờ")},
}
# How instructions name tools and parameters (label, unit).
TOOL_PHRASES = {
    "set_climate": "chỉnh điều hoà", "set_fan_speed": "chỉnh mức gió điều hoà", "navigate_to": "dẫn đường",
    "find_charging_station": "tìm trạm sạc", "play_music": "mở nhạc", "set_volume": "chỉnh âm lượng", "call_contact": "gọi điện",
    "read_messages": "đọc tin nhắn mới", "get_vehicle_status": "hỏi thông tin xe", "open_window": "mở cửa sổ",
    "lock_doors": "khoá cửa xe", "unlock_doors": "mở khoá cửa xe", "set_lights": "chỉnh đèn xe", "set_drive_mode": "đổi chế độ lái",
    "set_reminder": "hẹn nhắc việc", "lookup_traffic_law": "hỏi luật giao thông", "lookup_sign": "hỏi ý nghĩa biển báo",
}
PARAM_LABELS = {
    ("set_climate", "temperature"): ("nhiệt độ", " độ"), ("set_fan_speed", "level"): ("mức gió", ""),
    ("navigate_to", "destination"): ("điểm đến", ""), ("find_charging_station", "max_distance_km"): ("trong vòng", " km"),
    ("play_music", "query"): ("bài/ca sĩ/thể loại", ""), ("set_volume", "level"): ("mức âm lượng", ""),
    ("call_contact", "name"): ("người cần gọi", ""), ("read_messages", "count"): ("số tin nhắn", ""),
    ("get_vehicle_status", "field"): ("thông tin cần xem", ""), ("open_window", "position"): ("cửa sổ nào", ""),
    ("open_window", "percent"): ("mức mở", "%"), ("set_lights", "mode"): ("chế độ đèn", ""), ("set_drive_mode", "mode"): ("chế độ lái", ""),
    ("set_reminder", "text"): ("nội dung cần nhắc", ""), ("set_reminder", "minutes"): ("sau bao lâu", " phút"),
    ("lookup_sign", "code"): ("số hiệu biển", ""),
}
# The question for a required slot that is missing.
ASK = {
    ("set_fan_speed", "level"): "Bạn muốn để quạt mức mấy, từ 1 đến 7?",
    ("navigate_to", "destination"): "Bạn muốn đi đến đâu?",
    ("set_volume", "level"): "Bạn muốn chỉnh âm lượng mức bao nhiêu, từ 0 đến 30?",
    ("call_contact", "name"): "Bạn muốn gọi cho ai?",
    ("get_vehicle_status", "field"): "Bạn muốn xem gì: pin, quãng đường còn đi được, áp suất lốp hay số km đã chạy?",
    ("open_window", "position"): "Bạn muốn mở cửa sổ nào?",
    ("set_lights", "mode"): "Bạn muốn chỉnh đèn sang chế độ nào: tắt, tự động, cốt hay pha?",
    ("set_drive_mode", "mode"): "Bạn muốn chuyển sang chế độ lái nào: eco, comfort hay sport?",
    ("set_reminder", "text"): "Bạn muốn mình nhắc việc gì?",
    ("set_reminder", "minutes"): "Bạn muốn mình nhắc sau bao lâu?",
}

TOOL_NAMES = tuple(t.name for t in TOOLS)
BY_NAME = {t.name: t for t in TOOLS}


def literal(values) -> Column:
    """An array literal of strings; empty ones keep their type."""
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def lookup(mapping: dict, key: Column) -> Column:
    """A constant map's value for a key column, null if it has none."""
    return F.try_element_at(F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]), key)


def dotted(mapping: dict[tuple[str, str], object]) -> dict[str, object]:
    return {f"{tool}.{param}": v for (tool, param), v in mapping.items()}


def openai_tools(names: list[str] | None = None) -> list[dict]:
    """The tools (or those named, in that order) as function declarations with JSON schemas."""

    def schema(p: Param) -> dict:
        own = {"type": p.type, "enum": list(p.enum), "minimum": p.minimum, "maximum": p.maximum, "minLength": p.min_length, "description": p.description}
        return {k: v for k, v in own.items() if v not in (None, [])}

    out = []
    for t in TOOLS if names is None else [BY_NAME[n] for n in names]:
        parameters = {"type": "object", "properties": {p.name: schema(p) for p in t.params}, "required": list(t.required)}
        out.append({"type": "function", "function": {"name": t.name, "description": t.description, "parameters": parameters}})
    return out


def tools_frame(spark: SparkSession) -> DataFrame:
    """tool, param, type, enum, minimum, maximum, min_length, required, comparator, default_json: a row for each parameter, one without a param for tools that have none."""
    rows = []
    for t in TOOLS:
        for p in t.params or (None,):
            key = (t.name, p.name if p else "")
            comparator = "free_text" if key in FREE_TEXT else "name" if key in NAMES else "value"
            rows.append((t.name, p and p.name, p and p.type, list(p.enum) if p else [], float(p.minimum) if p and p.minimum is not None else None, float(p.maximum) if p and p.maximum is not None else None, p.min_length if p else None, bool(p and p.name in t.required), comparator if p else None, json.dumps(DEFAULTS[key]) if key in DEFAULTS else None))
    return spark.createDataFrame(rows, "tool string, param string, type string, enum array<string>, minimum double, maximum double, min_length int, required boolean, comparator string, default_json string")


def aliases_frame(spark: SparkSession) -> DataFrame:
    """tool, param, value (as text), phrase, place: every way to say a value."""
    rows = [(tool, param, str(v).lower() if isinstance(v, bool) else str(v), phrase, i) for table in (ALIASES, NUMBER_ALIASES) for (tool, param), values in table.items() for v, phrases in values.items() for i, phrase in enumerate(phrases)]
    return spark.createDataFrame(rows, "tool string, param string, value string, phrase string, place int")
