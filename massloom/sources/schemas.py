"""The scan table that every reader returns."""

SCAN = (
    "id string, index long, ms_level int, scan_time double, polarity int, is_profile boolean, mz array<double>, intensity array<double>, "
    "precursor struct<mz: double, intensity: double, charge: int, precursor_scan_id: string>, "
    "isolation_window struct<lower: double, target: double, upper: double>, annotations map<string, string>"
)
