"""Raster catalogue jobs: band roles per file, and validation of uploads with every reason reported.

A catalogue row is one file: ``upload_id, slot, mode, filename, driver, width, height, band_count, dtypes,
band_descriptions, crs, bounds STRUCT<left, bottom, right, top>, resolution STRUCT<x, y, units>, georeferenced,
date, sensor, band_roles, benchmark_mode``. A file that could not be read has a NULL driver.
Everything here is one projection per file and one grouping of the one or two files of an upload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.semantics import general_text, rounded, stripped_text, whole_percent_text

# Sensors, layouts, aliases, modes, file types. They decide which band is which.
SENSORS = ("auto", "sentinel2", "cartosat2s", "bgrn", "rgb", "sar")
PHOTO_DRIVERS = ("PNG", "JPEG", "WEBP")
OPTICAL_ROLES = ("blue", "green", "red", "nir", "swir1", "swir2")
RADAR_ROLES = ("vv", "vh", "hh", "hv")
S2_LAYOUTS = {
    13: ("B1", "B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B9", "B10", "B11", "B12"),
    12: ("B1", "B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B9", "B11", "B12"),
    10: ("B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B11", "B12"),
    4: ("B2", "B3", "B4", "B8"),
}
S2_ROLES = {"B2": "blue", "B3": "green", "B4": "red", "B8": "nir", "B11": "swir1", "B12": "swir2"}
S2_ONLY = ("B8A", "B9", "B10", "B11", "B12")
FIXED_LAYOUTS = {
    "cartosat2s": ("blue", "green", "red", "nir"),
    "bgrn": ("blue", "green", "red", "nir"),
    "rgb": ("red", "green", "blue"),
}
ALIASES = {
    "blue": "blue", "green": "green", "red": "red", "nir": "nir", "nearinfrared": "nir",
    "swir1": "swir1", "swir2": "swir2", "vv": "vv", "vh": "vh", "hh": "hh", "hv": "hv",
}
MODES = {"single": 1, "optical_sar": 2, "bi_temporal": 2}
TIFF_EXTS, IMAGE_EXTS = (".tif", ".tiff"), (".png", ".jpg", ".jpeg")
EXT_FOR_DRIVER = {"GTiff": ".tif", "PNG": ".png", "JPEG": ".jpg", "WEBP": ".jpg"}
LOW_OVERLAP = 0.5
MAX_FILE_BYTES = 500 * 1024 * 1024


def _text(value: str | None) -> str:
    return "cast(null as string)" if value is None else "'" + value.replace("'", "\\'") + "'"


def _array(items) -> str:
    return f"cast(array({', '.join('null' if i is None else _text(i) for i in items)}) as array<string>)"


def _map_case(key: str, table: dict) -> str:
    return f"case {key} " + " ".join(f"when {_text(k)} then {_text(v)}" for k, v in table.items()) + " end"


def _profile(sensor: str, kind: str, by_band: str, source: str, warnings: str = "cast(array() as array<string>)",
             names: str = "cast(null as array<string>)") -> str:
    return (f"named_struct('sensor', {_text(sensor)}, 'kind', {kind}, 'by_band', {by_band}, 'source', {_text(source)}, "
            f"'warnings', {warnings}, 'names', {names})")


def _pad(items) -> str:
    """Layout followed by unassigned bands up to the band count."""
    return f"transform(sequence(1, band_count), i -> get({_array(items)}, i - 1))"


_ROLES_OF_CODES = f"transform(s2_codes, c -> {_map_case('c', S2_ROLES)})"


def _s2_by_count(source: str) -> str:
    layouts = " ".join(f"when {n} then " + _profile(
        "sentinel2", "'optical'", _array([S2_ROLES.get(b) for b in bands]), source, names=_array(bands))
        for n, bands in S2_LAYOUTS.items())
    return f"case band_count {layouts} end"


def _sar_by_count(source: str) -> str:
    return "case band_count " + " ".join(
        f"when {n} then " + _profile("sar", "'sar'", _array(RADAR_ROLES[:n]), source, _array([
            f"SAR bands assumed to be {', '.join(r.upper() for r in RADAR_ROLES[:n])}; set band descriptions to override"]))
        for n in (1, 2)) + " end"


def _derive(df: DataFrame) -> DataFrame:
    kinds = "case when mode = 'optical_sar' and slot = 1 then 'optical' when mode = 'optical_sar' and slot = 2 then 'sar' end"
    tidy = "lower(regexp_replace(coalesce(d, ''), '[\\\\s_-]', ''))"
    df = df.withColumns({
        "expected_kind": F.expr(kinds),
        "hint": F.expr("coalesce(nullif(sensor, ''), 'auto')"),
        "user_roles": F.expr(f"if({stripped_text('band_roles')} <> '', transform(split(band_roles, ','), r -> lower({stripped_text('r')})), null)"),
        "tidy": F.expr(f"transform(coalesce(band_descriptions, array_repeat(cast(null as string), band_count)), d -> {tidy})")})
    df = df.withColumns({
        "s2_codes": F.expr("transform(tidy, d -> nullif(concat('B', upper(regexp_extract(d, '^b0?([0-9]{1,2}a?)$', 1))), 'B'))"),
        "described": F.expr(f"transform(tidy, d -> {_map_case('d', ALIASES)})"),
        "is_photo": F.expr(f"coalesce(driver in ({', '.join(_text(p) for p in PHOTO_DRIVERS)}), false)")})
    s2_only = _array(S2_ONLY)
    all_codes = f"size(s2_codes) > 0 and forall(s2_codes, c -> c is not null) and (arrays_overlap(s2_codes, {s2_only}) or size(s2_codes) >= 10)"
    return df.withColumns({
        "s2_described": F.expr(all_codes),
        "any_described": F.expr("exists(described, r -> r is not null)"),
        "used_roles": F.expr("filter(user_roles, r -> r <> '-')")})


def _band_error() -> str:
    allowed = sorted({*OPTICAL_ROLES, *RADAR_ROLES, "-"})
    bad = f"filter(user_roles, r -> not array_contains({_array(allowed)}, r))"
    radar = f"array_contains({_array(RADAR_ROLES)}, r)"
    expects = " ".join(f"when hint = '{s}' and band_count <> {len(layout)} then concat('{s} expects {len(layout)} bands, file has ', band_count)"
                       for s, layout in FIXED_LAYOUTS.items())
    counts = ", ".join(str(n) for n in S2_LAYOUTS)
    listed = ", ".join(str(n) for n in sorted(S2_LAYOUTS))
    assumed_sar = ("(not s2_described and not any_described and not is_photo and "
                   "(expected_kind = 'sar' or (expected_kind is null and band_count <= 2)))")
    return f"""case
      when hint not in ({', '.join(_text(s) for s in SENSORS)}) then concat("unknown sensor '", hint, "'; choose one of {', '.join(SENSORS)}")
      when user_roles is not null then case
        when hint <> 'auto' then 'give either a sensor or explicit band roles, not both'
        when size(user_roles) <> band_count then concat('band roles list has ', size(user_roles), ' entries but the file has ', band_count, ' bands')
        when size({bad}) > 0 then concat('unknown band roles [', concat_ws(', ', transform({bad}, r -> concat("'", r, "'"))), ']; use {', '.join(allowed)}')
        when size(used_roles) = 0 then 'band roles list marks every band as ignored'
        when size(array_distinct(used_roles)) <> size(used_roles) then 'each band role may appear only once'
        when exists(used_roles, r -> {radar}) and not forall(used_roles, r -> {radar}) then 'band roles mix optical and SAR bands in one file' end
      when hint = 'sentinel2' and band_count not in ({counts}) then concat('sentinel2 expects [{listed}] bands, file has ', band_count)
      {expects}
      when (hint = 'sar' or (hint = 'auto' and {assumed_sar})) and band_count not in (1, 2) then concat('SAR images must have 1 or 2 bands, file has ', band_count)
    end"""


def _resolved() -> str:
    radar = f"array_contains({_array(RADAR_ROLES)}, r)"
    fixed = " ".join(f"when hint = '{s}' then {_profile(s, _text('optical'), _array(layout), 'sensor_hint')}" for s, layout in FIXED_LAYOUTS.items())
    kind_used = f"if(forall(used_roles, r -> {radar}), 'sar', 'optical')"
    kind_found = f"if(forall(filter(described, r -> r is not null), r -> {radar}), 'sar', 'optical')"
    four = _array(["4 bands assumed to be blue, green, red, NIR (e.g. Cartosat-2S MX); set sensor to override"])
    three = _array(["3 bands assumed to be red, green, blue; set sensor to override"])
    none = ("array(concat('could not infer band roles for ', band_count, ' bands; spectral-index tools will not be available'))")
    return f"""case
      when band_error is not null or driver is null then null
      when user_roles is not null then {_profile('user', kind_used, "transform(user_roles, r -> nullif(r, '-'))", 'user_roles')}
      when hint = 'sentinel2' then {_s2_by_count('sensor_hint')}
      when hint = 'sar' then {_sar_by_count('sensor_hint')}
      {fixed}
      when s2_described then {_profile('sentinel2', _text('optical'), _ROLES_OF_CODES, 'descriptions', names='s2_codes')}
      when any_described then {_profile('described', kind_found, 'described', 'descriptions')}
      when is_photo and not expected_kind <=> 'sar' then if(band_count >= 3,
        {_profile('rgb', _text('optical'), _pad(FIXED_LAYOUTS['rgb']), 'band_count')}, {_profile('photo_gray', _text('optical'), _pad([None]), 'band_count')})
      when is_photo then {_profile('photo', _text('sar'), _pad(['vv']), 'band_count')}
      when expected_kind = 'sar' or (expected_kind is null and band_count <= 2) then {_sar_by_count('band_count')}
      when band_count in (10, 12, 13) then {_s2_by_count('band_count')}
      when band_count = 4 then {_profile('bgrn', _text('optical'), _array(FIXED_LAYOUTS['bgrn']), 'band_count', four)}
      when band_count = 3 then {_profile('rgb', _text('optical'), _array(FIXED_LAYOUTS['rgb']), 'band_count', three)}
      else {_profile('unknown', "coalesce(expected_kind, 'optical')", _pad([None]), 'unresolved', none)}
    end"""


def resolve_bands(catalogue: DataFrame) -> DataFrame:
    """Adds ``bands STRUCT<sensor, kind, roles MAP, band_names, source, warnings>`` and ``band_error``.

    Order of trust: explicit roles, sensor hint, band descriptions, photo rules, band count. When a role
    occurs twice the first band has it.
    """
    df = _derive(catalogue).withColumn("band_error", F.expr(_band_error())).withColumn("__p", F.expr(_resolved()))
    roles = ("map_from_entries(transform(array_distinct(filter(__p.by_band, r -> r is not null)), "
             "r -> struct(r, cast(array_position(__p.by_band, r) as int))))")
    names = "coalesce(__p.names, transform(__p.by_band, (r, i) -> coalesce(r, concat('band_', i + 1))))"
    bands = (f"if(__p is null, null, named_struct('sensor', __p.sensor, 'kind', __p.kind, 'roles', {roles}, 'band_names', {names}, "
             "'source', __p.source, 'warnings', __p.warnings))")
    return df.select(*catalogue.columns, "expected_kind", "hint", "user_roles", "band_error", F.expr(bands).alias("bands"))


# ------------------------------------------------------------------------------ validation

def _reason(code: str, message: str, slot: str = "cast(null as int)") -> str:
    return f"named_struct('code', {_text(code)}, 'message', {message}, 'file', {slot})"


def check_files(catalogue: DataFrame) -> DataFrame:
    """Per file: ``file_reason`` (the first thing that rejects it), its warnings and its date checks."""
    df = resolve_bands(catalogue)
    name = "concat('File ', slot, ' (', coalesce(filename, ''), ')')"
    tiff, image = (", ".join(_text(e) for e in group) for group in (TIFF_EXTS, IMAGE_EXTS))
    photos = ", ".join(_text(p) for p in PHOTO_DRIVERS)
    df = df.withColumn("named_ext", F.expr("lower(regexp_extract(coalesce(filename, ''), '[^/]([.][^./]+)$', 1))")).withColumn(
        "ext", F.expr(f"if(named_ext = '', coalesce({_map_case('driver', EXT_FOR_DRIVER)}, ''), named_ext)"))
    early = f"""case
      when named_ext = '' and driver is null then {_reason('unreadable_raster', f"concat({name}, ' is not a readable raster.')", 'slot')}
      when ext in ({image}) and not benchmark_mode then {_reason('image_requires_benchmark_mode', f"concat({name}, ' is ', upper(ltrim('.', ext)), '; only GeoTIFF is accepted unless benchmark_mode=true.')", 'slot')}
      when ext not in ({tiff}, {image}) then {_reason('unsupported_format', f"concat({name}, ' has unsupported type ', chr(39), if(ext = '', 'none', ext), chr(39), '. Allowed: .tif/.tiff', if(benchmark_mode, ', .png, .jpg/.jpeg', ''), '.')", 'slot')}
      when driver is null then {_reason('unreadable_raster', f"concat({name}, ' is not a readable raster.')", 'slot')}
      when (ext in ({tiff}) and driver <> 'GTiff') or (ext in ({image}) and driver not in ({photos})) then {_reason('format_mismatch', f"concat({name}, ' is named ', ext, ' but is actually ', driver, '.')", 'slot')}
    end"""
    code = "case when user_roles is not null then 'invalid_band_roles' when expected_kind = 'sar' and hint = 'auto' then 'wrong_modality' else 'sensor_mismatch' end"
    late = f"""case
      when band_error is not null then named_struct('code', {code}, 'message', concat({name}, ' ', if({code} = 'wrong_modality', 'must be the SAR image; ', ''), band_error, '.'), 'file', slot)
      when expected_kind = 'optical' and (bands.kind = 'sar' or band_count < 3) then {_reason('wrong_modality', f"concat({name}, ' must be the optical image (3+ bands); it has ', band_count, ' band(s)', if(bands.kind = 'sar', ' that look like SAR.', '.'))", 'slot')}
      when expected_kind = 'sar' and bands.kind <> 'sar' then {_reason('wrong_modality', f"concat({name}, ' must be the SAR image; its band descriptions look optical.')", 'slot')}
    end"""
    photo_of = "case ext when '.png' then 'PNG' when '.jpg' then 'JPEG' when '.jpeg' then 'JPEG' end"
    df = df.withColumn("__early", F.expr(early)).withColumn("__late", F.expr(f"if(__early is null, {late}, null)")).withColumn(
        "file_reason", F.expr("coalesce(__early, __late)"))
    warnings = f"""array_compact(concat(
      array(if(named_ext = '' and ext <> '', concat({name}, ' has no file extension; detected ', driver, ' from its content.'), null),
            if(__early is null and ext in ({image}) and driver <> {photo_of}, concat({name}, ' is named ', ext, ' but is actually ', driver, '; read as a photo.'), null),
            if(file_reason is null and not georeferenced, concat({name}, ' has no CRS/geotransform; areas will be reported in pixels, not m².'), null)),
      if(file_reason is null, transform(bands.warnings, w -> concat('File ', slot, ': ', w)), cast(array() as array<string>))))"""
    raw = f"nullif({stripped_text('date')}, '')"
    return df.withColumns({
        "warnings": F.expr(warnings), "__raw_date": F.expr(raw),
        "parsed_date": F.expr(f"if({raw} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$', try_to_date({raw}, 'yyyy-MM-dd'), null)")
    }).drop("__early", "__late")


def _box_text(side: str) -> str:
    parts = ", ', ', ".join(general_text(f"{side}.bounds.{k}") for k in ("left", "bottom", "right", "top"))
    return f"concat('[', {parts}, ']')"


def _resolution_text(side: str) -> str:
    return f"concat({general_text(f'{side}.resolution.x')}, 'x', {general_text(f'{side}.resolution.y')}, ' ', {side}.resolution.units)"


def validate_pairs(catalogue: DataFrame, today: str) -> DataFrame:
    """Per upload: ``ok``, every reason, every warning, and the facts of the pair.

    ``today`` is an argument. An unknown mode or a wrong number of files stops the checks; otherwise all
    problems are reported, first the dates, then the files, then the pair. The grouping is by upload,
    which has one or two files, and merges partially like a sum.
    """
    files = check_files(catalogue)
    info = F.struct("slot", "filename", "__raw_date", "parsed_date", "file_reason", "warnings", "bands", "width", "height",
                    "band_count", "crs", "bounds", "resolution", "georeferenced")
    grouped = files.groupBy("upload_id").agg(
        F.any_value("mode").alias("mode"), F.any_value("benchmark_mode").alias("benchmark_mode"), F.count(F.lit(1)).alias("files"),
        F.any_value(F.when(F.col("slot") == 1, info), True).alias("a"), F.any_value(F.when(F.col("slot") == 2, info), True).alias("b"))
    df = grouped.withColumn("expected", F.expr("case mode " + " ".join(f"when '{m}' then {n}" for m, n in MODES.items()) + " end"))
    df = df.withColumn("__runs", F.expr("expected is not null and files = expected")).withColumn(
        "__pair", F.expr("__runs and expected = 2 and a.file_reason is null and b.file_reason is null"))
    df = df.withColumn("__map", F.expr("__pair and a.georeferenced and b.georeferenced")).withColumn(
        "same_crs", F.expr("if(__map, a.crs <=> b.crs, null)"))
    inter = "named_struct('left', greatest(a.bounds.left, b.bounds.left), 'bottom', greatest(a.bounds.bottom, b.bounds.bottom), 'right', least(a.bounds.right, b.bounds.right), 'top', least(a.bounds.top, b.bounds.top))"
    df = df.withColumn("__i", F.expr(f"if(same_crs, {inter}, null)")).withColumn(
        "intersection", F.expr("if(__i.left < __i.right and __i.bottom < __i.top, __i, null)"))

    def area(box):
        return f"(({box}.right - {box}.left) * ({box}.top - {box}.bottom))"

    def near(axis):
        return f"abs(a.resolution.{axis} - b.resolution.{axis}) <= 1e-6D * greatest(abs(a.resolution.{axis}), abs(b.resolution.{axis}), 1e-12D)"

    share = rounded(f"try_divide({area('intersection')}, least({area('a.bounds')}, {area('b.bounds')}))", 4)
    df = df.withColumns({
        "overlap_fraction": F.expr(f"if(intersection is null, null, coalesce({share}, 0D))"),
        "same_resolution": F.expr(f"if(__pair, {near('x')} and {near('y')}, null)")})

    dated = []
    for side, slot in (("a", "1"), ("b", "2")):
        # one file has no second date to check
        there = "true" if slot == "1" else "expected = 2"
        dated.append(f"""case when not ({there}) then null
          when {side}.__raw_date is null then if(mode = 'bi_temporal', {_reason('missing_date', f"'File {slot} needs an acquisition date (YYYY-MM-DD).'", slot)}, null)
          when {side}.parsed_date is null then {_reason('invalid_date', f"concat('File {slot} date ', chr(39), {side}.__raw_date, chr(39), ' is not a valid YYYY-MM-DD date.')", slot)}
          when {side}.parsed_date > date'{today}' then {_reason('future_date', f"concat('File {slot} date ', {side}.__raw_date, ' is in the future.')", slot)} end""")
    same_date = f"if(mode = 'bi_temporal' and a.parsed_date = b.parsed_date, {_reason('same_date', 'concat(' + chr(39) + 'Both files have the same date (' + chr(39) + ', a.parsed_date, ' + chr(39) + '); bi_temporal needs two different dates.' + chr(39) + ')')}, null)"
    missing_crs = "concat_ws(', ', if(a.georeferenced, null, '1'), if(b.georeferenced, null, '2'))"
    pair_reasons = [
        f"if(__pair and mode = 'bi_temporal' and a.bands.kind <> b.bands.kind, {_reason('modality_mismatch', _concat('bi_temporal needs two images of the same kind; got ', '@a.bands.kind', ' and ', '@b.bands.kind', '.'))}, null)",
        f"if(__pair and not __map and not benchmark_mode, {_reason('missing_crs', _concat('File(s) ', '@' + missing_crs, ' have no CRS, so the pair cannot be checked for overlap. Upload georeferenced GeoTIFFs.'))}, null)",
        f"if(__pair and not __map and benchmark_mode and (a.width <> b.width or a.height <> b.height), {_reason('size_mismatch', _concat('Benchmark images without a CRS must have the same pixel size; got ', '@a.width', 'x', '@a.height', ' and ', '@b.width', 'x', '@b.height', '.'))}, null)",
        f"if(same_crs = false, {_reason('crs_mismatch', _concat('The two files use different CRS (', '@a.crs', ' vs ', '@b.crs', '). Reproject one so both match.'))}, null)",
        f"if(same_crs and intersection is null, {_reason('no_overlap', _concat('The two files do not overlap geographically (bounds ', '@' + _box_text('a'), ' vs ', '@' + _box_text('b'), ').'))}, null)"]
    stops = [f"if(expected is null, {_reason('invalid_mode', _concat('Unknown mode ', '@chr(39)', '@mode', '@chr(39)', '. Use one of: ' + ', '.join(MODES) + '.'))}, null)",
             f"if(expected is not null and files <> expected, {_reason('file_count', _concat('Mode ', '@chr(39)', '@mode', '@chr(39)', ' needs exactly ', '@expected', ' file(s); got ', '@files', '.'))}, null)"]
    every = ", ".join([*dated, same_date, "a.file_reason", "if(expected = 2, b.file_reason, null)", *pair_reasons])
    reasons = f"array_compact(if(__runs, array({every}), array({', '.join(stops)})))"
    none = "cast(array() as array<string>)"
    warnings = f"""if(__runs, array_compact(concat(coalesce(a.warnings, {none}), if(expected = 2, coalesce(b.warnings, {none}), {none}), array(
      if(__pair and not __map and benchmark_mode and a.width = b.width and a.height = b.height, 'Pair has no CRS; assuming the two images are pixel-aligned.', null),
      if(overlap_fraction < {LOW_OVERLAP}D, {_concat('The files overlap by only ', '@' + whole_percent_text('overlap_fraction'), ' of the smaller image; analysis uses the overlapping area only.')}, null),
      if(intersection is not null and not same_resolution, {_concat('Resolutions differ (', '@' + _resolution_text('a'), ' vs ', '@' + _resolution_text('b'), '); the second image will be resampled onto the first.')}, null),
      if(intersection is not null and mode = 'bi_temporal' and a.band_count <> b.band_count, {_concat('Band counts differ (', '@a.band_count', ' vs ', '@b.band_count', '); only band roles present in both dates can be compared.')}, null),
      if(__pair and mode = 'bi_temporal' and a.parsed_date > b.parsed_date, 'File 1 is dated after file 2; change analysis will compare them in chronological order.', null)))), {none})"""
    return df.withColumns({"reasons": F.expr(reasons), "warnings": F.expr(warnings)}).select(
        "upload_id", "mode", "benchmark_mode", (F.size("reasons") == 0).alias("ok"), "reasons", "warnings", "same_crs", "overlap_fraction",
        "intersection", "same_resolution")


def _concat(*parts: str) -> str:
    """SQL text of a message; parts that start with @ are expressions, the others are text."""
    return "concat(" + ", ".join(p[1:] if p.startswith("@") else _text(p) for p in parts) + ")"


def size_problems(files: DataFrame, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """Files over the byte limit, as ``file_too_large`` reasons. ``files`` is a listing ``(path, length)``."""
    return files.where(F.col("length") > limit).select("path", "length", F.lit("file_too_large").alias("code"))


def metadata_answer(files: DataFrame, fields: str = "fields") -> DataFrame:
    """One line per file with the asked facts, in the order asked. ``files`` needs ``bands`` and ``fields ARRAY<STRING>``."""
    labels = {  # fixed values
        "sentinel2": "Sentinel-2", "cartosat2s": "Cartosat-2S MX", "bgrn": "4-band blue/green/red/NIR", "rgb": "RGB", "sar": "SAR",
        "described": "from band descriptions", "user": "user-specified band roles", "unknown": "unknown"}
    roles = "concat_ws(', ', transform(map_entries(bands.roles), e -> concat(e.key, '=band ', e.value)))"
    facts = f"""case f
      when 'bands' then concat(band_count, ' band(s), ', coalesce(nullif({roles}, ''), 'no roles'),
        if(bands.source in ('descriptions', 'sensor_hint', 'user_roles'), '', ' (inferred from band count)'))
      when 'dtype' then concat('data type ', concat_ws('/', array_sort(array_distinct(dtypes))))
      when 'crs' then coalesce(concat('CRS ', crs), 'no CRS')
      when 'resolution' then concat('resolution ', {general_text('resolution.x')}, ' x ', {general_text('resolution.y')}, ' ', resolution.units)
      when 'size' then concat(width, ' x ', height, ' pixels')
      when 'bounds' then concat('bounds [', {general_text('bounds.left')}, ', ', {general_text('bounds.bottom')}, ', ', {general_text('bounds.right')}, ', ', {general_text('bounds.top')}, ']')
      when 'date' then coalesce(concat('date ', date), 'no date given')
      when 'sensor' then concat(bands.kind, ' image, sensor profile ', coalesce({_map_case('bands.sensor', labels)}, bands.sensor)) end"""
    return files.withColumn("line", F.expr(
        f"concat('File ', slot, ' (', filename, '): ', concat_ws('; ', transform({fields}, f -> {facts})))"))
