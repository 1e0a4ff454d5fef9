"""Pattern packs: tables of what a project's C calls mean. These are defaults for one kernel; a workspace brings its own."""

from __future__ import annotations

# Fixed values of a kernel's logging functions: levels of the families printk-like and device-like.
_LEVELS = {"emerg": "ERROR", "alert": "ERROR", "crit": "ERROR", "err": "ERROR", "warn": "WARN", "notice": "INFO", "info": "INFO"}
_FAMILIES = (("pr_", 0, _LEVELS | {"debug": "DEBUG", "cont": "DEBUG", "devel": "DEBUG"}), ("dev_", 1, _LEVELS | {"dbg": "DEBUG"}), ("netdev_", 1, {"err": "ERROR", "warn": "WARN", "info": "INFO", "dbg": "DEBUG"}))

#: (name, level, place of the format among the arguments, subsystem or None)
LOG_MACROS: tuple[tuple[str, str, int, str | None], ...] = (
    ("printk", "INFO", 0, None),
    *((prefix + suffix, level, place, None) for prefix, place, levels in _FAMILIES for suffix, level in levels.items()),
    *((name, "WARN", 0, None) for name in ("WARN", "WARN_ON", "WARN_ON_ONCE", "WARN_ONCE")),
    *((name, "ERROR", 0, None) for name in ("BUG", "BUG_ON")),
)

#: Functions that register a callback, by the place of the dispatch key among the arguments.
REGISTRATIONS: dict[str, int] = {
    name: place
    for place, names in {
        0: "request_irq request_threaded_irq platform_driver_register pci_register_driver spi_register_driver usb_register register_chrdev register_chrdev_region register_blkdev register_netdev misc_register kthread_run kthread_create kthread_create_on_node proc_create proc_create_data proc_create_single proc_create_seq debugfs_create_file module_init module_exit late_initcall subsys_initcall arch_initcall core_initcall device_initcall fs_initcall dev_add_pack inet_add_protocol call_rcu smp_call_function",
        1: "devm_request_irq devm_request_threaded_irq nf_register_net_hook nf_register_net_hooks call_srcu",
        2: "netif_napi_add netif_napi_add_weight",
    }.items()
    for name in names.split()
}
